"""Evaluation of probes: folds, controls, held-out predictions, transfer between cohorts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles
from tessera.operators.readouts import accuracy, auroc, confusion, fold_summary
from tessera.operators.solver import Model, Task, fit_tasks, score_tasks, staged
from tessera.sources.examples import number_rows

#: Distinct labels and cohorts that are brought to the driver, at most.
MOST_CLASSES, MOST_COHORTS = 1000, 1000


def fold_count(rows: DataFrame, label: str, folds: int, group: str | None = None) -> int:
    """Folds that there can be: no more than the groups and the members of the rarest class, two at least."""
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).agg((F.count_distinct(group) if group else F.count("*")).alias("n"))
    least = counts.agg(F.min("n")).first()[0] or 0
    if group:
        least = min(least, rows.select(group).distinct().count())
    return max(2, min(folds, least))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int = 42, group: str | None = None) -> DataFrame:
    """rows with fold: classes are spread evenly, and rows of one group share a fold.

    Units (rows, or groups with their most frequent class) are numbered in the order of their class and then of a hash
    with the seed; the number modulo folds is the fold.
    """
    unit = group or key
    if group:
        counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
        units = counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("_c"))
    else:
        units = rows.select(unit, F.col(label).alias("_c")).distinct()
    spread = units.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string"))))
    numbered = number_rows(spread, ["_c", "_h", unit], "_n").select(unit, (F.col("_n") % folds).cast("int").alias("fold"))
    return rows.join(numbered, unit)


def shuffled_labels(rows: DataFrame, key: str, label: str, seed: int, name: str = "shuffled") -> DataFrame:
    """rows with a permutation of the labels: the n-th row by key gets the label of the n-th by a hash with the seed."""
    given = number_rows(rows.select(F.col(label).alias(name), F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))).alias("_h"), F.col(key).alias("_k")), ["_h", "_k"], "_n")
    return number_rows(rows, [key], "_n").join(given.select("_n", name), "_n").drop("_n")


def multiclass_scores(rows: DataFrame, coef: Sequence[Sequence[float]], intercept: Sequence[float], mean: Sequence[float], scale: Sequence[float]) -> DataFrame:
    """rows with probabilities (softmax), predicted_class (the first of the greatest) and score, the last probability."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    standard = F.zip_with(F.zip_with(doubles("values"), lit(mean), lambda x, m: x - m), lit([s or 1.0 for s in scale]), lambda x, s: x / s)
    scored = rows.withColumn("_z", standard).withColumn("_l", F.array(*[dot(F.col("_z"), lit(c)) + float(b) for c, b in zip(coef, intercept)]))
    powers = F.transform("_l", lambda x: F.exp(x - F.array_max("_l")))
    scored = scored.withColumn("_p", powers)
    total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("probabilities", F.transform("_p", lambda p: p / total))
    first = (F.array_position("_l", F.array_max("_l")) - 1).cast("int")
    return scored.withColumns({"predicted_class": first, "score": F.element_at("probabilities", -1)}).drop("_z", "_l", "_p")


def prediction_rows(scored: DataFrame, key: str, label: str, classes: Sequence[str], positive: str | None = None) -> DataFrame:
    """(key, true_label, true_index, predicted_label, predicted_index, correct, probability, outcome) of scored rows, which
    have predicted_class and probability; outcome is TP, TN, FP or FN where a positive class is named."""
    names = F.array(*map(F.lit, classes))
    true = F.col(label).cast("string")
    rows = scored.select(
        key, true.alias("true_label"), (F.array_position(names, true) - 1).cast("int").alias("true_index"), F.get(names, F.col("predicted_class")).alias("predicted_label"),
        F.col("predicted_class").alias("predicted_index"), F.bround("probability", 6).alias("probability"),
    )
    rows = rows.withColumn("correct", F.col("true_label") == F.col("predicted_label"))
    if positive is None:
        return rows
    hit = F.when(F.col("predicted_label") == positive, F.when(F.col("correct"), "TP").otherwise("FP")).otherwise(F.when(F.col("correct"), "TN").otherwise("FN"))
    return rows.withColumn("outcome", hit)


def class_list(rows: DataFrame, label: str) -> list:
    """The distinct labels in order, null left out; MOST_CLASSES at most."""
    found = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values")
    return found


def class_number(label: str, classes: Sequence) -> Column:
    """The place of the label in classes, from 0; null for another one."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    return F.when(place > 0, place - 1).cast("int")


def _binary(label: str, positive) -> Column:
    return (F.col(label) == F.lit(positive)).cast("int")


def measures(scored: DataFrame, classes: int, keys: Sequence[str] = ("task", "strength")) -> DataFrame:
    """keys, n_test, accuracy, balanced_accuracy, auroc and, for two classes, the confusion counts and rates, of score_tasks() rows.

    The AUROC of more than two classes is the mean over classes of one against the rest; it is null unless all classes are there.
    """
    keys = list(keys)
    named = scored.withColumns({"true_label": F.col("true_index"), "predicted_label": F.col("predicted_index")})
    out = accuracy(named, keys).join(named.groupBy(*keys).agg(F.count("*").alias("n_test")), keys)
    if classes == 2:
        area = auroc(named, F.col("true_index") == 1, "probability", keys)
        return out.join(area, keys).join(confusion(named, 1, keys), keys)
    each = named.select(*keys, "true_index", F.posexplode("probabilities").alias("_class", "_chance"))
    area = auroc(each, F.col("true_index") == F.col("_class"), "_chance", [*keys, "_class"])
    return out.join(area.groupBy(*keys).agg(F.when(F.count("auroc") == classes, F.avg("auroc")).alias("auroc")), keys)


def fold_tasks(folds: int, y: Column, classes: int, name: tuple = (), where: Column | None = None, test_y: Column | None = None, without: Sequence[np.ndarray] | None = None) -> list[Task]:
    """A task for each fold of the column `fold`, among the rows of `where`: fitted to the others, tried on it."""
    here = F.lit(True) if where is None else where
    return [Task((*name, i), here & (F.col("fold") != i), here & (F.col("fold") == i), y, classes, test_y, without[i] if without is not None else None) for i in range(folds)]


def held_out(rows: DataFrame, key: str, label: str, positive, folds: int, reg: float = 1e-4) -> DataFrame:
    """(key, fold, true_label, predicted_label, probability): every row, scored by the probe of the other folds. All folds are fitted together."""
    tasks = fold_tasks(folds, _binary(label, positive), 2)
    scored = score_tasks(rows, key, tasks, fit_tasks(rows, tasks, alphas=[reg]))
    return scored.select(key, F.col("task").alias("fold"), F.col("true_index").alias("true_label"), F.col("predicted_index").alias("predicted_label"), "probability")


def cross_validate(rows: DataFrame, key: str, label: str, positive=None, folds: int = 5, group: str | None = None, reg: float = 1e-4, seed: int = 42, control: bool = True) -> DataFrame:
    """One row: mean and std over folds of accuracy, balanced accuracy and AUROC, n_folds, majority, shuffled and selectivity.

    With `positive` the probe tells that label from the others; without, all labels are classes. Probes are tried on the fold that they have
    not seen; majority is the accuracy of the training rows' most frequent class on it. The control is fitted to permuted labels and tried on the true
    ones; selectivity is the accuracy less the control's. All folds and controls are fitted together.
    """
    n = fold_count(rows, label, folds, group)
    dealt = stratified_folds(rows, key, label, n, seed, group)
    classes = None if positive is not None else class_list(rows, label)
    number = (lambda c: _binary(c, positive)) if positive is not None else (lambda c: class_number(c, classes))
    k = 2 if positive is not None else len(classes)
    tasks = fold_tasks(n, number(label), k)
    if control:
        dealt = shuffled_labels(dealt, key, label, seed)
        tasks += fold_tasks(n, number("shuffled"), k, test_y=number(label))
    scored = score_tasks(dealt, key, tasks, fit_tasks(dealt, tasks, alphas=[reg]))
    by_task = measures(scored.where(F.col("task") < n), k)
    out = fold_summary(by_task, [], ["accuracy", "balanced_accuracy", "auroc"])
    counts = dealt.withColumn("_y", number(label)).where("_y is not null").groupBy("fold", "_y").agg(F.count("*").alias("n")).collect()
    shares = []
    for i in range(n):
        train, test = np.zeros(k), np.zeros(k)
        for r in counts:
            (test if r["fold"] == i else train)[r["_y"]] += r["n"]
        shares.append(test[train.argmax()] / test.sum() if test.sum() else np.nan)
    out = out.withColumn("majority", F.lit(float(np.nanmean(shares)) if shares else None))
    if not control:
        return out
    shuffled = accuracy(scored.where(F.col("task") >= n).withColumns({"true_label": F.col("true_index"), "predicted_label": F.col("predicted_index")}), ["task"])
    return out.crossJoin(shuffled.agg(F.avg("accuracy").alias("shuffled"))).withColumn("selectivity", F.col("accuracy_mean") - F.col("shuffled"))  # one row each


def _cohorts(rows: DataFrame, cohort: str) -> list:
    names = [r[0] for r in rows.select(cohort).where(F.col(cohort).isNotNull()).distinct().orderBy(cohort).limit(MOST_COHORTS + 1).collect()]
    if len(names) > MOST_COHORTS:
        raise ValueError(f"{cohort} has more than {MOST_COHORTS} values")
    return names


def transfer(rows: DataFrame, key: str, cohort: str, label: str, positive, folds: int = 3, regs: Sequence[float] = (1e-4,), seed: int = 42) -> DataFrame:
    """(reg, train_cohort, test_cohort, accuracy, balanced_accuracy, within, delta, cosine): probes fitted to one cohort, tried on another.

    within is the cross-validated accuracy of the test cohort, delta the accuracy less that; cosine compares the
    directions of the two cohorts' probes. On its own cohort a probe's accuracy is the cross-validated one. The folds of all cohorts, and all
    cohorts at all regs, are fitted together; there are MOST_COHORTS cohorts at most.
    """
    names = _cohorts(rows, cohort)
    y, at = _binary(label, positive), lambda name: F.col(cohort) == F.lit(name)
    counts = {n: fold_count(rows.where(at(n)), label, folds) for n in names}
    # Folds are dealt within each cohort: units in the order of cohort, class and hash.
    dealt = stratified_folds(rows.withColumn("_both", F.struct(F.col(cohort).alias("c"), F.col(label).alias("l"))), key, "_both", max(counts.values(), default=2), seed).drop("_both")
    folds = {n: F.pmod("fold", F.lit(counts[n])) for n in names}
    tasks, place = [], {}
    for n in names:
        place["whole", n] = len(tasks)
        tasks.append(Task(("whole", n), at(n), F.col(cohort).isNotNull() & ~at(n), y, 2))
        for i in range(counts[n]):
            tasks.append(Task(("fold", n), at(n) & (folds[n] != i), at(n) & (folds[n] == i), y, 2))
    models = fit_tasks(dealt, tasks, alphas=regs)
    listed = F.array(*[F.lit(str(t.name[0])) for t in tasks]), F.array(*[F.lit(t.name[1]) for t in tasks])
    scored = score_tasks(dealt, key, tasks, models).join(rows.select(key, F.col(cohort).alias("test_cohort")), key)
    scored = scored.select("strength", F.get(listed[0], F.col("task")).alias("kind"), F.get(listed[1], F.col("task")).alias("train_cohort"), "test_cohort", "task", F.col("true_index").alias("true_label"), F.col("predicted_index").alias("predicted_label"))
    keys = ["strength", "train_cohort", "test_cohort"]
    across = accuracy(scored.where("kind = 'whole'"), keys)
    within = accuracy(scored.where("kind = 'fold'"), ["task", *keys]).groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.avg("balanced_accuracy").alias("balanced_accuracy"))
    base = within.select(F.col("strength").alias("_s"), F.col("test_cohort").alias("_t"), F.col("accuracy").alias("within"))
    found = across.unionByName(within).join(F.broadcast(base), (F.col("strength") == F.col("_s")) & (F.col("test_cohort") == F.col("_t")))  # a row for each cohort and reg
    by = {(m.task, m.strength): m.standard.ravel() for m in models if m.fitted}
    pairs = []
    for reg in regs:
        for one in names:
            for other in names:
                u, v = by.get((place["whole", one], reg)), by.get((place["whole", other], reg))
                length = float(np.linalg.norm(u) * np.linalg.norm(v)) if u is not None and v is not None else 0.0
                pairs.append((float(reg), one, other, float(u @ v) / length if length else None))
    kind = rows.schema[cohort].dataType.simpleString()
    cosines = rows.sparkSession.createDataFrame(pairs, f"strength double, train_cohort {kind}, test_cohort {kind}, cosine double")
    text = lambda c: F.col(c).cast("string").alias(c)
    return cosines.join(found, keys, "left").select(F.col("strength").alias("reg"), text("train_cohort"), text("test_cohort"), "accuracy", "balanced_accuracy", "within", (F.col("accuracy") - F.col("within")).alias("delta"), "cosine")


def transfer_split(
    rows: DataFrame, key: str, label: str, splits: Sequence[str], train_values: Sequence, test_values: Sequence,
    cs: Sequence[float] = (1.0,), cohort: str | None = None, group: str | None = None, predictions: bool = False,
) -> DataFrame:
    """A row for each split column, cohort and C: n_train, n_test and the measures of a model fitted to the rows whose split is one of
    train_values and tried on those where it is one of test_values.

    Splits are compared as strings. All models of all splits, cohorts and C are fitted together. A model whose training rows have one
    class, or without test rows, has null measures. If a group has rows on both sides of a split, of the same cohort, that is an error. With
    predictions, the scored rows (key, split_name, cohort, c, true_label, predicted_label, probability) are returned instead.
    """
    classes = class_list(rows, label)
    y, names = class_number(label, classes), _cohorts(rows, cohort) if cohort else [None]
    inside = lambda split, values: F.coalesce(F.col(split).cast("string").isin([str(v) for v in values]), F.lit(False))
    tasks = []
    for split in splits:
        for name in names:
            here = F.lit(True) if name is None else F.coalesce(F.col(cohort) == F.lit(name), F.lit(False))
            tasks.append(Task((split, None if name is None else str(name)), here & inside(split, train_values), here & inside(split, test_values), y, len(classes)))
        if group:
            sides = rows.where(F.col(group).isNotNull()).groupBy(group, *([cohort] if cohort else [])).agg(F.max(inside(split, train_values)).alias("a"), F.max(inside(split, test_values)).alias("b"))
            leaking = [r[0] for r in sides.where("a and b").select(group).orderBy(group).limit(5).collect()]
            if leaking:
                raise ValueError(f"groups on both sides of {split}: {leaking}")
    models = fit_tasks(rows, tasks, cs=cs)
    scored = score_tasks(rows, key, tasks, models)
    spark = rows.sparkSession
    table = spark.createDataFrame([(m.task, *tasks[m.task].name, float(m.strength), m.n_train) for m in models], "task int, split_name string, cohort string, c double, n_train long")
    if predictions:
        label_of = lambda c: F.get(F.array(*[F.lit(str(x)) for x in classes]), F.col(c))
        joined = scored.join(F.broadcast(table), (scored["task"] == table["task"]) & (scored["strength"] == table["c"]))  # MOST_MODELS rows
        return joined.select(key, "split_name", "cohort", "c", label_of("true_index").alias("true_label"), label_of("predicted_index").alias("predicted_label"), "probability")
    found = measures(scored, len(classes)).withColumnRenamed("task", "_task")
    return table.join(found, (F.col("task") == F.col("_task")) & (F.col("c") == F.col("strength")), "left").drop("_task", "task", "strength").withColumn("n_test", F.coalesce("n_test", F.lit(0)))


def residualized(rows: DataFrame, key: str, label: str, positive, nuisance: str, nuisance_values: Sequence, folds: int = 3, least: float = 0.75, reg: float = 1e-4, seed: int = 42) -> DataFrame:
    """One row: cross-validated accuracy of a probe on the values (raw), and on what is left of them when the directions
    of probes for the nuisance are taken away (null); their rank, and whether the nuisance can still be told from what
    is left (leaks: accuracy of `least` or more).

    In each fold the directions come from the training rows alone; the values are read as they are, and the directions are taken away
    within the solver.
    """
    n = fold_count(rows, label, folds)
    dealt = stratified_folds(rows, key, label, n, seed)
    targets = [_binary(nuisance, v) for v in nuisance_values]
    first = [t for target in targets for t in fold_tasks(n, target, 2)]
    fitted = fit_tasks(dealt, first, alphas=[reg])
    without = [np.array([fitted[j * n + i].coef[0] for j in range(len(targets)) if fitted[j * n + i].fitted]).reshape(-1, fitted[0].coef.shape[1]) for i in range(n)]
    y = _binary(label, positive)
    tasks = [*fold_tasks(n, y, 2, ("raw",)), *fold_tasks(n, y, 2, ("null",), without=without), *fold_tasks(n, targets[0], 2, ("nuisance",), without=without)]
    scored = score_tasks(dealt, key, tasks, fit_tasks(dealt, tasks, alphas=[reg]))
    named = scored.withColumns({"true_label": F.col("true_index"), "predicted_label": F.col("predicted_index")})
    by_task = accuracy(named, ["task"])
    part = lambda i: F.avg(F.when((F.col("task") / n).cast("int") == i, F.col("accuracy")))
    rank = max(int(np.linalg.matrix_rank(w)) if w.size else 0 for w in without)
    out = by_task.agg(part(0).alias("raw"), part(1).alias("null"), part(2).alias("nuisance"))
    return out.select("raw", "null", (F.col("raw") - F.col("null")).alias("delta"), F.lit(rank).alias("rank"), "nuisance", (F.col("nuisance") >= least).alias("leaks"))


def staged_fine_tune(
    rows: DataFrame, key: str, label: str, split: str, stages: Sequence[Sequence], test_values: Sequence, epochs: Sequence[int] = (), classes: Sequence | None = None, **training
) -> tuple[DataFrame, Model]:
    """(key, true_label, predicted_label, probability) of the rows whose split is one of test_values, and the model.

    stages are lists of values of the split column, trained on in their order: each begins with what the one before has learned (see
    solver.staged(), which training goes to). Splits are compared as strings.
    """
    classes = list(classes) if classes is not None else class_list(rows, label)
    inside = lambda values: F.coalesce(F.col(split).cast("string").isin([str(v) for v in values]), F.lit(False))
    y = class_number(label, classes)
    model = staged(rows, key, [inside(s) for s in stages], y, len(classes), epochs, **training)
    scored = score_tasks(rows, key, [Task((), F.lit(False), inside(test_values), y, len(classes))], [model])
    label_of = lambda c: F.get(F.array(*[F.lit(x) for x in classes]), F.col(c))
    return scored.select(key, label_of("true_index").alias("true_label"), label_of("predicted_index").alias("predicted_label"), "probability"), model


def text_validated(rows: DataFrame, key: str, text: str, label: str, positive, fit: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 3) -> DataFrame:
    """Held-out rows (key, true_label, predicted_label, fold, probability) of a text model: fit takes the rows to learn
    from and those to score."""
    dealt = stratified_folds(rows, key, label, fold_count(rows, label, folds))
    n = fold_count(rows, label, folds)
    parts = [fit(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i)) for i in range(n)]
    scored = reduce(DataFrame.unionByName, parts)
    true = (F.col(label) == F.lit(positive)).cast("int")
    return scored.select(key, "fold", true.alias("true_label"), (F.col("probability") >= 0.5).cast("int").alias("predicted_label"), "probability")
