"""Linear readouts: label encoding, splits, probes, inference and metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles
from tessera.sources.examples import number_rows, ranked


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """rows with class_index: the place of the label, as text, in lexicographic order; null for a null label."""
    classes = rows.select(F.col(label).cast("string").alias("_class")).where("_class is not null").distinct()
    table = number_rows(classes, ["_class"], "class_index").withColumn("class_index", F.col("class_index").cast("int"))
    return rows.join(table, F.col(label).cast("string") == F.col("_class"), "left").drop("_class")


def hash_fold(key: Column, folds: int, seed: int = 42) -> Column:
    """A fold for each key; rows of one key, such as a group, share it."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in several splits, which a grouped evaluation must not have."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def majority(rows: DataFrame, label: str, train: Column) -> DataFrame:
    """majority_label of the training rows (the lesser of equal ones) and its accuracy on the others."""
    best = rows.where(train).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).first()
    value = F.lit(best[label] if best else None)
    return rows.where(~train).groupBy(value.alias("majority_label")).agg(F.avg((F.col(label) == value).cast("double")).alias("accuracy"))


def accuracy(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, and balanced_accuracy: the mean over true classes of the share predicted right."""
    per_class = rows.groupBy(*keys, "true_label").agg(F.count("*").alias("n"), F.count_if(F.col("true_label") == F.col("predicted_label")).alias("right"))
    grouped = per_class.groupBy(*keys)
    return grouped.agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.avg(F.col("right") / F.col("n")).alias("balanced_accuracy"))


def confusion(rows: DataFrame, positive, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the rates tpr, tnr, fpr, fnr of a binary task; a rate over no rows is null."""
    t, p = F.col("true_label") == F.lit(positive), F.col("predicted_label") == F.lit(positive)
    counts = rows.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return counts.withColumns({"tpr": rate("tp", "fn"), "tnr": rate("tn", "fp"), "fpr": rate("fp", "tn"), "fnr": rate("fn", "tp")})


def auroc(rows: DataFrame, truth: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from ranks, equal scores having their average rank; null with one class only.

    Rows are counted per distinct score before they are ranked. A null score counts as the least.
    """
    levels = rows.groupBy(*keys, score).agg(F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_n"))
    below = ranked(levels, list(keys), [score], "_n", "_below")
    won = below.withColumn("won", F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("_p") * F.sum("_n")).alias("auroc"))


def fold_summary(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric over folds, nulls left out, and n_folds."""
    parts = [f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return metrics.groupBy(*keys).agg(*parts, F.count("*").alias("n_folds"))


def probe_scores(rows: DataFrame, coef: Sequence[float], intercept: float, mean: Sequence[float], scale: Sequence[float], threshold: float = 0.5) -> DataFrame:
    """rows with logit, probability and predicted_class of a stored binary probe; a scale of 0 counts as 1."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    standard = F.zip_with(F.zip_with(doubles("values"), lit(mean), lambda x, m: x - m), lit([s or 1.0 for s in scale]), lambda x, s: x / s)
    logit = dot(standard, lit(coef)) + F.lit(float(intercept))
    scored = rows.withColumn("logit", logit)
    scored = scored.withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))
    return scored.withColumn("predicted_class", (F.col("probability") >= threshold).cast("int"))


def fit_probe(rows: DataFrame, label: str, positive, reg: float = 1e-4) -> dict:
    """A balanced logistic probe on standardized values: coef, intercept, scaler mean and scale (population std)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from tessera.operators.represent import moments

    n, mean, cov = moments(rows)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    safe = np.where(scale > 1e-12, scale, 1.0)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    standard = F.zip_with(F.zip_with(doubles("values"), lit(mean), lambda x, m: x - m), lit(safe), lambda x, s: x / s)
    y = (F.col(label) == F.lit(positive)).cast("double")
    share = rows.agg(F.avg(y)).first()[0]
    weight = F.when(y == 1.0, 0.5 / max(share, 1e-12)).otherwise(0.5 / max(1 - share, 1e-12))
    data = rows.select(array_to_vector(standard).alias("features"), y.alias("y"), weight.alias("w"))
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=reg, standardization=False, maxIter=200).fit(data)
    return {"coef": model.coefficients.toArray(), "intercept": float(model.intercept), "mean": mean, "scale": scale, "threshold": 0.5}


def residual_rows(rows: DataFrame, nuisance: np.ndarray) -> DataFrame:
    """rows with the values' part in the span of the nuisance directions (rows of a matrix) taken away.

    A batch of rows is one matrix product with the orthonormal basis. Null values stay null; values of another length, or with a null
    element, have no such part and become nulls.
    """
    q = np.linalg.svd(nuisance, full_matrices=False)
    basis = q[2][q[1] > 1e-10 * max(q[1].max(), 1e-300)]
    if not len(basis):
        return rows.withColumn("values", doubles("values"))

    @F.arrow_udf("array<double>")
    def left(vectors: pa.Array) -> pa.Array:
        return pa.array(_residuals(vectors, basis), pa.list_(pa.float64()))

    return rows.withColumn("values", left(doubles("values")))


def _residuals(vectors: pa.Array, basis: np.ndarray) -> list[np.ndarray | list | None]:
    """Each vector less its part in the span of the basis."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(vectors).to_numpy()
    gaps = np.bincount(owner[vectors.flatten().is_null().to_numpy(zero_copy_only=False)], minlength=len(vectors)) > 0
    whole = (sizes == basis.shape[1]) & ~gaps
    x = vectors.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, basis.shape[1])
    with np.errstate(invalid="ignore"):
        done = iter(x - (x @ basis.T) @ basis)
    return [next(done) if ok else None if size < 0 else [None] * max(size, basis.shape[1]) for ok, size in zip(whole.tolist(), sizes.tolist())]


def text_counts(rows: DataFrame, key: str, text: str, n_max: int = 2) -> DataFrame:
    """(key, term, count): words of two or more letters or digits in lower case, and n-grams of up to n_max of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    rows = rows.select(key, words.alias("_w"))

    def grams(n: int):
        at = lambda i: F.array_join(F.slice("_w", i, n), " ")
        count = F.size("_w") - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), at)).otherwise(F.array().cast("array<string>"))

    kept = [grams(n) for n in range(1, n_max + 1)]
    return rows.select(key, F.explode(F.concat(*kept)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("count"))


def text_baseline(train: DataFrame, test: DataFrame, text: str, label: str, positive, reg: float = 1e-3) -> DataFrame:
    """The rows of test with probability: a logistic model of hashed words and word pairs, fitted to the rows of train
    that have a label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_g"),
        HashingTF(inputCol="_w", outputCol="_f1", numFeatures=1 << 14),
        HashingTF(inputCol="_g", outputCol="_f2", numFeatures=1 << 14),
        VectorAssembler(inputCols=["_f1", "_f2"], outputCol="_f"),
        LogisticRegression(featuresCol="_f", labelCol="_y", regParam=reg, maxIter=50, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r"),
    ]
    data = train.withColumn("_y", (F.col(label) == F.lit(positive)).cast("double")).where("_y is not null")
    scored = Pipeline(stages=stages).fit(data).transform(test)
    return scored.select(*test.columns, vector_to_array("_p")[1].alias("probability"))


def predicted_counts(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per predicted concept: rows, those that are right, and the chance of a right guess.

    A row's prediction is the concept (concept, vector) of the greatest score, the first of equal ones.
    """
    from tessera.operators.project import scores

    best = F.max_by("concept", F.bround("score", 9) - F.col("concept") * 1e-12)
    hits = scores(rows, concepts).groupBy("example_key", "label").agg(best.alias("predicted"))
    chance = 1.0 / max(1, rows.select("label").distinct().count())
    return hits.groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("n_right"), F.lit(chance).alias("chance"))
