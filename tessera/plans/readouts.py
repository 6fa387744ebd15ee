"""Queries on readouts: metrics of a stored probe, and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import rounded
from tessera.operators import evaluate as ev
from tessera.operators import readouts as rd
from tessera.plans.features import vectors
from tessera.plans.registry import query, table

#: A probe as stored: the sum of the first eight elements, standardized, against labels under 5.
_COEF, _MEAN, _SCALE = [1.0, -0.5] * 4 + [0.0] * 56, [0.1] * 64, [2.0] * 63 + [0.0]

_P = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
z AS (SELECT vec_id, label, sum(CASE WHEN d >= 8 THEN 0.0 WHEN d % 2 = 0 THEN 1.0 ELSE -0.5 END * (v - 0.1) / CASE d WHEN 63 THEN 1.0 ELSE 2.0 END) + 0.05 AS logit FROM e GROUP BY ALL),
p AS (SELECT vec_id, label, (label < 5)::INT AS true_label, (1 / (1 + exp(-logit)) >= 0.5)::INT AS predicted_label, logit, 1 / (1 + exp(-logit)) AS probability, vec_id % 5 AS fold FROM z)
"""


def _scored(spark, sf_dir):
    scored = rd.probe_scores(vectors(spark, sf_dir), _COEF, 0.05, _MEAN, _SCALE)
    return scored.withColumn("true_label", (F.col("label") < 5).cast("int")).withColumn("predicted_label", F.col("predicted_class")).withColumn("fold", F.col("example_key") % 5)


@query(f"WITH {_P} SELECT vec_id AS example_key, round_even(logit, 4) + 0 AS logit, round_even(probability, 4) + 0 AS probability, predicted_label AS predicted_class FROM p")
def rd_probe_infer(spark, sf_dir):
    return _scored(spark, sf_dir).select("example_key", rounded(F.col("logit")).alias("logit"), rounded(F.col("probability")).alias("probability"), "predicted_class")


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source)::INT - 1 AS class_index FROM documents")
def rd_encode(spark, sf_dir):
    return rd.encode_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "class_index")


@query("""
WITH t AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL ORDER BY n DESC, event_type LIMIT 1)
SELECT t.event_type AS majority_label, round_even(avg((e.event_type = t.event_type)::INT), 4) + 0 AS accuracy FROM events e, t WHERE event_id % 5 = 0 GROUP BY ALL
""")
def rd_majority(spark, sf_dir):
    found = rd.majority(table(spark, sf_dir, "events"), "event_type", F.col("event_id") % 5 != 0)
    return found.select("majority_label", rounded(F.col("accuracy")).alias("accuracy"))


_COUNTS = "count(*) FILTER ({0}) AS {1}"


@query(f"""
WITH {_P}, c AS (SELECT fold, count(*) FILTER (true_label = 1 AND predicted_label = 1) AS tp, count(*) FILTER (true_label = 0 AND predicted_label = 1) AS fp,
  count(*) FILTER (true_label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (true_label = 0 AND predicted_label = 0) AS tn FROM p GROUP BY fold)
SELECT *, round_even(tp / (tp + fn), 4) + 0 AS tpr, round_even(tn / (tn + fp), 4) + 0 AS tnr, round_even(fp / (tn + fp), 4) + 0 AS fpr, round_even(fn / (tp + fn), 4) + 0 AS fnr FROM c
""")
def rd_confusion(spark, sf_dir):
    found = rd.confusion(_scored(spark, sf_dir), 1, ["fold"])
    return found.withColumns({c: rounded(F.col(c)) for c in ("tpr", "tnr", "fpr", "fnr")})


@query(f"""
WITH {_P}, c AS (SELECT fold, true_label, count(*) AS n, count(*) FILTER (true_label = predicted_label) AS r FROM p GROUP BY ALL)
SELECT fold, round_even(sum(r) / sum(n), 4) + 0 AS accuracy, round_even(avg(r / n), 4) + 0 AS balanced_accuracy FROM c GROUP BY fold
""")
def rd_balanced_acc(spark, sf_dir):
    found = rd.accuracy(_scored(spark, sf_dir), ["fold"])
    return found.select("fold", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(f"""
WITH {_P}, r AS (SELECT fold, true_label AS t, (rank() OVER w + rank() OVER w + count(*) OVER (PARTITION BY fold, s) - 1) / 2.0::DOUBLE AS rank
  FROM (SELECT *, round_even(logit, 1) + 0 AS s FROM p) WINDOW w AS (PARTITION BY fold ORDER BY s))
SELECT fold, round_even((sum(rank) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0)), 4) + 0 AS auroc
FROM r GROUP BY fold
""")
def rd_auroc(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("s", rounded(F.col("logit"), 1))
    return rd.auroc(rows, F.col("true_label") == 1, "s", ["fold"]).select("fold", rounded(F.col("auroc")).alias("auroc"))


@query(f"""
WITH {_P}, f AS (SELECT fold, avg((true_label = predicted_label)::INT) AS a, avg(probability) AS b FROM p GROUP BY fold)
SELECT round_even(avg(a), 4) + 0 AS accuracy_mean, round_even(stddev_pop(a), 4) + 0 AS accuracy_std, round_even(avg(b), 4) + 0 AS probability_mean, round_even(stddev_pop(b), 4) + 0 AS probability_std, count(*) AS n_folds FROM f
""")
def rd_fold_agg(spark, sf_dir):
    right = (F.col("true_label") == F.col("predicted_label")).cast("int")
    folds = _scored(spark, sf_dir).groupBy("fold").agg(F.avg(right).alias("accuracy"), F.avg("probability").alias("probability"))
    found = rd.fold_summary(folds, [], ["accuracy", "probability"])
    return found.select(*(rounded(F.col(c)).alias(c) for c in found.columns if c != "n_folds"), "n_folds")


@query("SELECT source, count(DISTINCT lang) AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def rd_leakage(spark, sf_dir):
    return rd.leaking_groups(table(spark, sf_dir, "documents"), "source", "lang")


def _sided(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("side", F.when(F.col("label") < 5, "low").otherwise("high"))


@query()
def rd_probe_fit(spark, sf_dir):
    rows = _sided(spark, sf_dir)
    train = rd.hash_fold(F.col("example_key"), 5) != 0
    probe = rd.fit_probe(rows.where(train), "side", "low")
    scored = rd.probe_scores(rows.where(~train), probe["coef"], probe["intercept"], probe["mean"], probe["scale"])
    scored = scored.withColumn("true_label", (F.col("side") == "low").cast("int")).withColumn("predicted_label", F.col("predicted_class"))
    return rd.accuracy(scored)


@query()
def rd_probe_cv(spark, sf_dir):
    return ev.cross_validate(_sided(spark, sf_dir), "example_key", "side", "low", 3)


_HASHED = "md5('42:' || vec_id) AS h"


@query(f"""
WITH u AS (SELECT vec_id, label, {_HASHED} FROM embeddings)
SELECT vec_id AS example_key, ((row_number() OVER (ORDER BY label, h, vec_id) - 1) % 5)::INT AS fold FROM u
""")
def rd_stratified_folds(spark, sf_dir):
    return ev.stratified_folds(vectors(spark, sf_dir), "example_key", "label", 5).select("example_key", "fold")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, arg_min(lang, struct_pack(a := -n, b := lang)) AS c FROM c GROUP BY source),
u AS (SELECT source, row_number() OVER (ORDER BY c, md5('42:' || source), source) - 1 AS i FROM m)
SELECT doc_id, (i % 4)::INT AS fold FROM documents JOIN u USING (source)
""")
def rd_grouped_folds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return ev.stratified_folds(docs, "doc_id", "lang", 4, group="source").select("doc_id", "fold")


@query(f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT label, row_number() OVER (ORDER BY h, vec_id) AS i FROM (SELECT vec_id, label, {_HASHED} FROM embeddings))
SELECT vec_id AS example_key, label AS shuffled FROM a JOIN b USING (i)
""")
def rd_shuffled_control(spark, sf_dir):
    return ev.shuffled_labels(vectors(spark, sf_dir), "example_key", "label", 42).select("example_key", "shuffled")


#: Three classes; the weight of class c for element d is ((c + 1) (d mod 5) - 4) / 10.
_MULTI = [[((c + 1) * (d % 5) - 4) / 10 for d in range(64)] for c in range(3)]
_MULTI_SQL = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
l AS (SELECT vec_id, label % 3 AS truth, c, sum(((c + 1) * (d % 5) - 4) / 10.0 * (v - 0.1) / 2.0) + c * 0.05 AS logit FROM e, range(3) t(c) GROUP BY vec_id, label, c),
p AS (SELECT vec_id, truth, c, logit, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS x FROM l),
q AS (SELECT vec_id, truth, c, logit, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM p),
b AS (SELECT vec_id, truth, arg_min(c, struct_pack(a := -logit, b := c)) AS best, max(p) FILTER (c = 2) AS score, max(p) AS top FROM q GROUP BY ALL)
"""


def _multi(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("truth", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    return ev.multiclass_scores(rows, _MULTI, [0.0, 0.05, 0.1], [0.1] * 64, [2.0] * 64)


@query(f"WITH {_MULTI_SQL} SELECT vec_id AS example_key, best::INT AS predicted_class, round_even(score, 4) + 0 AS score FROM b")
def rd_multiclass_infer(spark, sf_dir):
    return _multi(spark, sf_dir).select("example_key", "predicted_class", rounded(F.col("score")).alias("score"))


@query(f"""
WITH {_MULTI_SQL}
SELECT vec_id AS example_key, 'c' || truth AS true_label, truth::INT AS true_index, 'c' || best AS predicted_label, best::INT AS predicted_index, truth = best AS correct, round_even(top, 6) + 0 AS probability,
       CASE WHEN best = 0 THEN CASE WHEN truth = best THEN 'TP' ELSE 'FP' END ELSE CASE WHEN truth = best THEN 'TN' ELSE 'FN' END END AS outcome FROM b
""")
def rd_prediction_rows(spark, sf_dir):
    scored = _multi(spark, sf_dir).withColumn("probability", F.array_max("probabilities"))
    return ev.prediction_rows(scored, "example_key", "truth", ["c0", "c1", "c2"], "c0")


@query(f"""
WITH {_MULTI_SQL}, r AS (SELECT c, p, (truth = c)::INT AS t FROM q), k AS (SELECT c, t, rank() OVER w + (count(*) OVER (PARTITION BY c, round_even(p, 6)) - 1) / 2.0::DOUBLE AS rank FROM r WINDOW w AS (PARTITION BY c ORDER BY round_even(p, 6))),
a AS (SELECT c, (sum(rank) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0)) AS auroc FROM k GROUP BY c)
SELECT round_even(avg(auroc), 4) + 0 AS auroc FROM a
""")
def rd_multiclass_auroc(spark, sf_dir):
    listed = _multi(spark, sf_dir).select("truth", F.posexplode("probabilities").alias("c", "p")).withColumn("p", F.bround("p", 6))
    true = F.col("truth") == F.concat(F.lit("c"), F.col("c").cast("string"))
    return rd.auroc(listed, true, "p", ["c"]).select(F.avg("auroc").alias("a")).select(rounded(F.col("a")).alias("auroc"))


@query()
def rd_transfer(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("cohort", F.col("example_key") % 2).withColumn("side", (F.col("label") % 2).cast("int"))
    return ev.transfer(rows, "example_key", "cohort", "side", 1, folds=2)


def _split(spark, sf_dir):
    """The vectors with three classes, two cohorts and two splits: by key, and by a hash."""
    rows = vectors(spark, sf_dir).withColumns({"kind": F.concat(F.lit("c"), (F.col("label") % 3).cast("string")), "cohort": F.col("example_key") % 2})
    named = lambda n: F.when(n == 0, "test").when(n == 1, "dev").otherwise("train")
    return rows.withColumns({"by_key": named(F.col("example_key") % 5), "by_hash": named(F.pmod(F.crc32(F.col("example_key").cast("string")), F.lit(5)))})


@query()
def rd_transfer_split(spark, sf_dir):
    return ev.transfer_split(_split(spark, sf_dir), "example_key", "kind", ["by_key", "by_hash"], ["train", "dev"], ["test"], [0.01, 0.1, 1.0], "cohort")


@query()
def rd_multiclass_cv(spark, sf_dir):
    return ev.cross_validate(_split(spark, sf_dir), "example_key", "kind", folds=3)


@query()
def rd_staged_fine_tune(spark, sf_dir):
    scored, _ = ev.staged_fine_tune(_split(spark, sf_dir), "example_key", "kind", "by_key", [["train"], ["dev"]], ["test"], [2, 1])
    return scored


@query()
def rd_residualized(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("side", (F.col("label") < 5).cast("int")).withColumn("nuisance", (F.col("label") % 2).cast("int"))
    return ev.residualized(rows, "example_key", "side", 1, "nuisance", [1], folds=2)


@query()
def rd_text_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    fit = lambda train, test: rd.text_baseline(train, test, "text", "quality", 1)
    found = ev.text_validated(rows, "doc_id", "text", "quality", 1, fit, folds=2)
    return found.select("doc_id", "fold", "true_label", "predicted_label", F.bround("probability", 3).alias("probability"))
