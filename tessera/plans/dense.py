"""Queries on scores of every token."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import mean_vectors, rounded
from tessera.operators import dense
from tessera.plans.features import layered, tokened
from tessera.plans.registry import query

#: Tokens of eight elements in two layers (even and odd examples), and the mean of each label in each layer.
_TOKENS = """
e AS (SELECT vec_id, label, vec_id % 2 AS layer, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
t AS (SELECT vec_id, label, layer, d // 8 AS token_pos, d % 8 AS i, v FROM e),
m AS (SELECT layer, label AS coordinate, i, avg(v) AS c FROM t GROUP BY ALL),
s AS (SELECT t.vec_id, t.label, t.layer, t.token_pos, m.coordinate, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS score FROM t JOIN m USING (layer, i) GROUP BY ALL)
"""


def _scored(spark, sf_dir, only=None):
    rows = tokened(spark, sf_dir).withColumns({"layer": F.col("example_key") % 2, "label": F.col("label").cast("string")})
    points = mean_vectors(rows, ["layer", "label"], "values").select("layer", F.col("label").alias("coordinate"), F.col("values").alias("vector"))
    return dense.dense_scores(rows, points, "cosine", only, ["example_key", "label", "token_pos"])


@query(f"WITH {_TOKENS} SELECT vec_id AS example_key, layer, token_pos::INT AS token_pos, coordinate::VARCHAR AS coordinate, round_even(score, 4) + 0 AS score FROM s")
def tok_dense_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("example_key", "layer", "token_pos", "coordinate", rounded(F.col("score")).alias("score"))


@query(f"""
WITH {_TOKENS}, o AS (SELECT * FROM s WHERE coordinate = label)
SELECT vec_id AS example_key, layer, label::VARCHAR AS coordinate, token_pos::INT AS token_pos, round_even(score, 4) + 0 AS score FROM o
""")
def tok_own_scores(spark, sf_dir):
    series = dense.token_series(_scored(spark, sf_dir, "label"))
    listed = series.select("example_key", "layer", "coordinate", F.explode(F.arrays_zip("token_positions", "scores")).alias("t"))
    return listed.select("example_key", "layer", "coordinate", F.col("t.token_positions").alias("token_pos"), rounded(F.col("t.scores")).alias("score"))


@query(f"""
WITH {_TOKENS}, b AS (SELECT layer, coordinate, token_pos, avg(score) FILTER (label = 0) AS a, avg(score) FILTER (label = 1) AS z FROM s GROUP BY ALL)
SELECT layer, coordinate::VARCHAR AS coordinate, token_pos::INT AS token_pos, round_even(a, 4) + 0 AS baseline_score, round_even(z, 4) + 0 AS target_score, round_even(z - a, 4) + 0 AS delta
FROM b WHERE a IS NOT NULL AND z IS NOT NULL
""")
def view_dose_deltas(spark, sf_dir):
    found = dense.side_deltas(_scored(spark, sf_dir), F.col("label"), "0", "1")
    return found.select("layer", "coordinate", "token_pos", *(rounded(F.col(c)).alias(c) for c in ("baseline_score", "target_score", "delta")))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
t AS (SELECT vec_id, label, d // 16 AS layer, d % 16 AS i, v FROM e WHERE d // 16 IN (0, 2)),
m AS (SELECT layer, label AS coordinate, i, avg(v) AS c FROM t GROUP BY ALL)
SELECT vec_id AS example_key, layer::INT AS layer, coordinate::VARCHAR AS coordinate, 1 AS slice_count, round_even(sum(v * c), 4) + 0 AS score
FROM t JOIN m USING (layer, i) WHERE coordinate IN (0, 1, 2) GROUP BY ALL
""")
def tok_single_scores(spark, sf_dir):
    rows = layered(spark, sf_dir)
    points = mean_vectors(rows, ["layer", "label"], "values").select("layer", F.col("label").cast("string").alias("coordinate"), F.col("values").alias("vector"))
    found = dense.single_token_scores(rows, points, ["0", "1", "2"], [0, 2], "dot")
    return found.withColumn("score", rounded(F.col("score")))
