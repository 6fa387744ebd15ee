"""Queries on feature vectors: directions, projections, tokens, routing and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, doubles, mean_vectors, norm, rounded, softmax, top_k
from tessera.operators import geometry, patch, project, represent, routing, tokens
from tessera.operators.reports import pair_table
from tessera.plans.registry import query, table
from tessera.sources import arrays

_LAYERS, _DIMS, _TOKENS, _TOKEN_DIMS = 4, 16, 8, 8
_POS, _NEG = "label = 0", "label = 1"

#: Elements of the vectors for SQL: d counts from 0.
_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_key, label, values: the embeddings as pooled features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_key"), "label", doubles("embedding").alias("values"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as four layers of 16 dimensions."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(_LAYERS - 1)), lambda i: F.slice("values", i * _DIMS + 1, F.lit(_DIMS)))
    return vectors(spark, sf_dir).select("example_key", "label", F.posexplode(parts).alias("layer", "values"))


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as eight tokens of eight dimensions."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(_TOKENS - 1)), lambda i: F.slice("values", i * _TOKEN_DIMS + 1, F.lit(_TOKEN_DIMS)))
    return vectors(spark, sf_dir).select("example_key", "label", F.posexplode(parts).alias("token_pos", "values"))


def elements(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, dim, value: a row for each element, rounded."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_DIRECTION = f"""
{_E},
m AS (SELECT d, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS raw FROM e GROUP BY d),
u AS (SELECT d, raw, raw / sqrt(sum(raw * raw) OVER ()) AS w FROM m)
"""


@query(f"""
WITH {_DIRECTION},
s AS (SELECT e.vec_id, e.label, sum(e.v * u.w) AS score FROM e JOIN u USING (d) GROUP BY ALL)
SELECT label, count(*) AS n, round_even(avg(score), 4) + 0 AS mean, round_even(min(score), 4) + 0 AS min, round_even(max(score), 4) + 0 AS max,
       round_even(stddev_pop(score), 4) + 0 AS std FROM s GROUP BY label
""")
def direction_project(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    scored = project.scores(rows, represent.direction(rows, _POS, _NEG).select("vector"))
    out = scored.groupBy("label").agg(F.count("*").alias("n"), *(f("score").alias(n) for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"), (F.stddev_pop, "std"))))
    return out.select("label", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "min", "max", "std")))


@query(f"WITH {_DIRECTION} SELECT d::INT AS dim, round_even(raw, 4) + 0 AS raw, round_even(w, 4) + 0 AS unit FROM u")
def rep_direction(spark, sf_dir):
    found = represent.direction(vectors(spark, sf_dir), _POS, _NEG)
    both = found.select(F.posexplode(F.arrays_zip(F.col("raw_vector").alias("raw"), F.col("vector").alias("unit"))).alias("dim", "e"))
    return both.select("dim", rounded(F.col("e.raw")).alias("raw"), rounded(F.col("e.unit")).alias("unit"))


@query(f"""
WITH {_E}, g AS (SELECT vec_id % 7 AS grp, label % 2 AS side, d, avg(v) AS v FROM (SELECT *, vec_id % 7 * 10 + label % 2 AS k FROM e) GROUP BY vec_id % 7, label % 2, d),
r AS (SELECT d, avg(v) FILTER (side = 0) - avg(v) FILTER (side = 1) AS raw FROM g GROUP BY d)
SELECT d::INT AS dim, round_even(raw, 4) + 0 AS value FROM r
""")
def rep_direction_grouped(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("side", F.col("label") % 2)
    rows = rows.withColumn("grp", F.concat_ws("_", (F.col("example_key") % 7).cast("string"), F.col("side").cast("string")))
    return elements(represent.grouped_direction(rows, "grp", F.col("side") == 0, F.col("side") == 1), "raw_vector")


@query(f"""
WITH {_E}, m AS (SELECT vec_id % 50 AS case_id, d, avg(v) FILTER (label = 0) AS p, avg(v) FILTER (label = 1) AS n FROM e GROUP BY ALL)
SELECT case_id, d::INT AS dim, round_even(p - n, 4) + 0 AS value FROM m WHERE p IS NOT NULL AND n IS NOT NULL
""")
def rep_pair_delta(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("case_id", F.col("example_key") % 50)
    return elements(represent.pair_delta(rows, "case_id", _POS, _NEG), "values", "case_id")


@query(f"""
WITH {_E} SELECT d // 16 AS layer, label::VARCHAR AS label, (d % 16)::INT AS dim, round_even(avg(v), 4) + 0 AS value FROM e GROUP BY ALL
""")
def rep_centroid(spark, sf_dir):
    return elements(represent.centroids(layered(spark, sf_dir), "label", ["layer"]), "values", "layer", "label").withColumn("layer", F.col("layer").cast("long"))


_SPACE = f"""
{_E}, m AS (SELECT d // 16 AS layer, label, d % 16 AS dim, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT layer, label::VARCHAR AS label, dim, v - avg(v) OVER (PARTITION BY layer, dim) AS raw, n FROM m WHERE n >= 5),
u AS (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY layer, label)) AS norm FROM r)
"""


@query(f"WITH {_SPACE} SELECT layer, label, dim::INT AS dim, round_even(raw / norm, 4) + 0 AS value FROM u")
def rep_concept_space(spark, sf_dir):
    space = represent.concept_space(layered(spark, sf_dir), "label", 5, ["layer"])
    return elements(space, "vector", "layer", "label").withColumn("layer", F.col("layer").cast("long"))


@query(f"WITH {_SPACE} SELECT layer, label, n AS count, round_even(norm, 4) + 0 AS norm FROM u WHERE dim = 0")
def rep_concept_norms(spark, sf_dir):
    space = represent.concept_space(layered(spark, sf_dir), "label", 5, ["layer"])
    return space.select(F.col("layer").cast("long").alias("layer"), "label", "count", rounded(F.col("norm")).alias("norm"))


@query(f"""
WITH {_E}, p AS (SELECT label, d, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL)
SELECT d::INT AS dim, round_even(max(v) FILTER (label = 0) - avg(v) FILTER (label <> 0 AND n >= 5), 4) + 0 AS value FROM p GROUP BY d
""")
def rep_role_axis(spark, sf_dir):
    return elements(represent.role_axis(vectors(spark, sf_dir), "label", F.col("label") == 0, 5), "raw_vector")


@query(f"""
WITH {_E}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM e GROUP BY vec_id)
SELECT vec_id AS example_key, d::INT AS dim, round_even(v / norm, 4) + 0 AS value FROM e JOIN n USING (vec_id)
""")
def rep_unit_direction(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("vector", F.col("values"))
    return elements(represent.unit_direction(rows), "raw_vector", "example_key")


@query(f"""
WITH {_E}, n AS (SELECT vec_id, sqrt(avg(v * v)) AS rms FROM e GROUP BY vec_id)
SELECT vec_id AS example_key, round_even(sum(v / rms), 4) + 0 AS total, round_even(max(v / rms), 4) + 0 AS top FROM e JOIN n USING (vec_id) GROUP BY vec_id
""")
def rep_rms_normalize(spark, sf_dir):
    v = represent.rms_normalize(F.col("values"))
    return vectors(spark, sf_dir).select("example_key", v.alias("v")).select("example_key", rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), rounded(F.array_max("v")).alias("top"))


@query()
def rep_pca_variance(spark, sf_dir):
    space = represent.subspace(vectors(spark, sf_dir), 5)
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(space["explained"])], "component int, explained double")


@query()
def rep_range_variance(spark, sf_dir):
    space = represent.range_subspace(vectors(spark, sf_dir), 5)
    return spark.createDataFrame([(i, round(float(e), 4)) for i, e in enumerate(space["explained"])], "component int, explained double")


@query()
def rep_group_coordinates(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = represent.group_coordinates(rows, "label", represent.range_subspace(rows, 3))
    return found.select("label", "count", F.transform("coordinates", lambda x: F.bround(x, 3)).alias("coordinates"))


@query()
def rep_concept_geometry(spark, sf_dir):
    means = mean_vectors(layered(spark, sf_dir), ["layer", "label"], "values").select("layer", F.col("label").cast("string").alias("concept"), F.col("values").alias("vector"))
    return geometry.concept_geometry(means, 2, 3)


@query()
def rep_subspace_coordinates(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return represent.project_rows(rows, represent.subspace(rows, 3)).select("example_key", "label", F.transform("coordinates", lambda x: F.bround(x, 3)).alias("coordinates"))


@query()
def rep_lda(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = represent.lda(rows, "label", 2)
    return spark.createDataFrame([(k, i, round(float(x), 4)) for k, row in enumerate(found) for i, x in enumerate(row)], "component int, dim int, value double")


_UNITS = f"""
{_E}, m AS (SELECT d // 16 AS layer, d % 16 AS dim, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS raw FROM e GROUP BY ALL),
u AS (SELECT layer, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY layer)) AS w FROM m),
s AS (SELECT vec_id, label, layer, sum(v * w) AS score, sum(v * w) / sqrt(sum(v * v)) AS cosine FROM e JOIN u ON d // 16 = layer AND d % 16 = dim GROUP BY ALL)
"""


def _layer_scores(spark, sf_dir, metric="dot"):
    rows = layered(spark, sf_dir)
    return project.scores(rows, represent.direction(rows, _POS, _NEG, ["layer"]).select("layer", "vector"), metric, ["layer"])


@query(f"WITH {_UNITS} SELECT vec_id AS example_key, label, layer, round_even(score, 4) + 0 AS score FROM s")
def proj_scores(spark, sf_dir):
    return _layer_scores(spark, sf_dir).select("example_key", "label", F.col("layer").cast("long").alias("layer"), rounded(F.col("score")).alias("score"))


@query(f"WITH {_UNITS} SELECT vec_id AS example_key, label, layer, round_even(cosine, 4) + 0 AS score FROM s")
def proj_cosine(spark, sf_dir):
    return _layer_scores(spark, sf_dir, "cosine").select("example_key", "label", F.col("layer").cast("long").alias("layer"), rounded(F.col("score")).alias("score"))


@query(f"""
WITH {_UNITS} SELECT vec_id AS example_key, round_even(avg(score), 4) + 0 AS mean, round_even(min(score), 4) + 0 AS min, round_even(max(score), 4) + 0 AS max,
  round_even(stddev_pop(score), 4) + 0 AS std, round_even(coalesce(regr_slope(score, layer), 0), 4) + 0 AS trend, round_even(arg_max(score, layer) - arg_min(score, layer), 4) + 0 AS first_last_delta
FROM s GROUP BY vec_id
""")
def proj_summary(spark, sf_dir):
    found = project.summarize(_layer_scores(spark, sf_dir), ["example_key"], "layer")
    return found.select("example_key", *(rounded(F.col(c)).alias(c) for c in project.SUMMARIES))


@query(f"""
WITH {_UNITS} SELECT layer, round_even(quantile_cont(score, 1 / 3.0::DOUBLE), 4) + 0 AS low, round_even(quantile_cont(score, 2 / 3.0::DOUBLE), 4) + 0 AS high,
  round_even(min(score), 4) + 0 AS min, round_even(max(score), 4) + 0 AS max, count(*) AS count FROM s GROUP BY layer
""")
def proj_quantile_bands(spark, sf_dir):
    bands = project.quantile_bands(_layer_scores(spark, sf_dir), ["layer"], "score", 3)
    low, high = F.col("thresholds")[0], F.col("thresholds")[1]
    return bands.select(F.col("layer").cast("long").alias("layer"), *(rounded(c).alias(n) for c, n in ((low, "low"), (high, "high"), (F.col("min"), "min"), (F.col("max"), "max"))), "count")


@query(f"""
WITH {_UNITS}, q AS (SELECT layer, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM s GROUP BY layer),
x AS (SELECT layer, (score > a)::INT + (score > b)::INT + (score > c)::INT AS band FROM s JOIN q USING (layer))
SELECT layer, band, count(*) AS n FROM x GROUP BY ALL
""")
def proj_band_assign(spark, sf_dir):
    scored = _layer_scores(spark, sf_dir)
    bands = project.quantile_bands(scored, ["layer"], "score", 4).select("layer", "thresholds")
    placed = project.assign_band(scored.join(bands, "layer"), F.col("thresholds"), "score")
    return placed.groupBy(F.col("layer").cast("long").alias("layer"), "band").agg(F.count("*").alias("n"))


@query(f"""
WITH {_UNITS}, g AS (SELECT layer, avg(score) FILTER (label = 0) - avg(score) FILTER (label = 1) AS gap FROM s GROUP BY layer)
SELECT layer, round_even(gap, 4) + 0 AS gap, row_number() OVER (ORDER BY round_even(abs(gap), 9) DESC, layer)::INT AS rank FROM g
""")
def proj_gap_select(spark, sf_dir):
    found = project.gap_by_layer(_layer_scores(spark, sf_dir), _POS, _NEG)
    return found.select(F.col("layer").cast("long").alias("layer"), rounded(F.col("gap")).alias("gap"), "rank")


@query(f"WITH {_E} SELECT vec_id AS example_key, (d % 8)::INT AS dim, round_even(v, 4) + 0 AS value FROM e WHERE d // 8 = 7")
def tok_last(spark, sf_dir):
    return elements(tokens.last_token(tokened(spark, sf_dir), ["example_key"]), "values", "example_key")


@query(f"WITH {_E} SELECT vec_id AS example_key, (d % 8)::INT AS dim, round_even(avg(v), 4) + 0 AS value FROM e WHERE d // 8 BETWEEN 2 AND 4 GROUP BY ALL")
def tok_slice_mean(spark, sf_dir):
    return elements(tokens.pool(tokens.slice_tokens(tokened(spark, sf_dir), 2, 5), ["example_key"]), "values", "example_key")


def _sections(spark, sf_dir):
    """Section body: positions 1 to 1 + key % 5; section tail: the last position and key % 8."""
    keys = vectors(spark, sf_dir).select("example_key")
    body = keys.select("example_key", F.lit("body").alias("section"), F.explode(F.sequence(F.lit(1), (1 + F.col("example_key") % 5).cast("int"))).alias("token_pos"))
    tail = keys.select("example_key", F.lit("tail").alias("section"), F.explode(F.array(F.lit(7), (F.col("example_key") % 8).cast("int"))).alias("token_pos"))
    return body.unionByName(tail)


_SECTIONS = """
sec AS (SELECT vec_id, 'body' AS section, unnest(range(1, 2 + vec_id % 5)) AS pos FROM embeddings UNION
        SELECT vec_id, 'tail', unnest([7, vec_id % 8]) FROM embeddings)
"""


@query(f"""
WITH {_E}, {_SECTIONS}
SELECT vec_id AS example_key, section, (d % 8)::INT AS dim, round_even(avg(v), 4) + 0 AS value FROM e JOIN sec USING (vec_id) WHERE d // 8 = pos GROUP BY ALL
""")
def tok_section_pool(spark, sf_dir):
    inside = tokens.in_sections(tokened(spark, sf_dir), _sections(spark, sf_dir))
    return elements(tokens.pool(inside, ["example_key", "section"]), "values", "example_key", "section")


@query(f"""
WITH {_SECTIONS}, p AS (SELECT DISTINCT vec_id, pos FROM sec), r AS (SELECT *, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM p)
SELECT vec_id AS example_key, min(pos)::INT AS start, (max(pos) + 1)::INT AS stop FROM r GROUP BY vec_id, g
""")
def tok_islands(spark, sf_dir):
    return tokens.contiguous_spans(_sections(spark, sf_dir), ["example_key"])


@query(f"""
WITH {_SECTIONS}, c AS (SELECT DISTINCT vec_id, pos, dense_rank() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS i FROM sec WHERE section = 'body')
SELECT sec.vec_id AS example_key, sec.section, pos::INT AS token_pos, i::INT AS index FROM sec JOIN c USING (vec_id, pos) WHERE sec.section = 'tail'
""")
def tok_rebase(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    tail = sections.where("section = 'tail'").distinct()
    return tokens.rebase(tail, sections.where("section = 'body'"), ["example_key"]).select("example_key", "section", "token_pos", "index")


@query(f"""
WITH {_E}, x AS (SELECT vec_id, d // 8 AS tok, d % 8 AS d, exp(v - max(v) OVER (PARTITION BY vec_id, d // 8)) AS p FROM e)
SELECT vec_id AS example_key, tok::INT AS token_pos, d::INT AS expert, round_even(p / sum(p) OVER (PARTITION BY vec_id, tok), 4) + 0 AS value FROM x
""")
def moe_softmax(spark, sf_dir):
    rows = tokened(spark, sf_dir).select("example_key", "token_pos", softmax(F.col("values")).alias("p"))
    return elements(rows, "p", "example_key", "token_pos").withColumnRenamed("dim", "expert")


@query(f"""
WITH {_E}, r AS (SELECT vec_id, d // 8 AS token, d % 8 AS expert, v, row_number() OVER (PARTITION BY vec_id, d // 8 ORDER BY v DESC, d DESC) AS rank FROM e)
SELECT vec_id AS example_key, token::INT AS token_pos, rank::INT AS rank, expert::INT AS expert, round_even(v, 4) + 0 AS logit FROM r WHERE rank <= 2
""")
def moe_topk(spark, sf_dir):
    rows = tokened(spark, sf_dir).select("example_key", "token_pos", F.posexplode(top_k(F.col("values"), 2)).alias("rank", "t"))
    return rows.select("example_key", "token_pos", (F.col("rank") + 1).alias("rank"), F.col("t.index").alias("expert"), rounded(F.col("t.value")).alias("logit"))


@query(f"""
WITH {_E}, r AS (SELECT d // 8 AS token, d % 8 AS expert, row_number() OVER (PARTITION BY vec_id, d // 8 ORDER BY v DESC, d DESC) AS rank FROM e)
SELECT token::INT AS token_pos, expert::INT AS expert, count(*) AS tokens FROM r WHERE rank <= 2 GROUP BY ALL
""")
def moe_load(spark, sf_dir):
    return routing.expert_load(routing.derive(tokened(spark, sf_dir), "values", 2), ["token_pos"])


@query(f"""
WITH {_E}, r AS (SELECT vec_id, d // 8 AS tok, d % 8 AS expert, v, row_number() OVER (PARTITION BY vec_id, d // 8 ORDER BY v DESC, d DESC) AS rank FROM e),
w AS (SELECT vec_id, tok, expert, CASE WHEN rank <= 3 THEN v - min(v) FILTER (rank <= 3) OVER (PARTITION BY vec_id, tok) + 1e-6 ELSE 0 END AS s FROM r)
SELECT vec_id AS example_key, tok::INT AS token_pos, expert::INT AS expert, round_even(s / sum(s) OVER (PARTITION BY vec_id, tok), 4) + 0 AS value FROM w
""")
def moe_dense(spark, sf_dir):
    rows = routing.derive(tokened(spark, sf_dir), "values", 3)
    none = F.lit(None)
    vector = routing.routing_vector(none.cast("array<double>"), none.cast("array<double>"), F.col("expert_ids"), F.col("expert_weights"), none.cast("map<int,bigint>"), 8)
    return elements(rows.select("example_key", "token_pos", vector.alias("v")), "v", "example_key", "token_pos").withColumnRenamed("dim", "expert")


_C = [[0.6, 0.8, 0, 0, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0, 0, 0]]
_T = f"{_E}, t AS (SELECT vec_id, label, d // 8 AS tok, list(v ORDER BY d) AS x FROM e GROUP BY ALL)"
_ALONG = "(0.6 * {0}[1] + 0.8 * {0}[2])"
_OUT = "SELECT example_key, token_pos::INT AS token_pos, (i - 1)::INT AS dim, round_even(y[i], 4) + 0 AS value FROM y, (SELECT unnest(range(1, 9)) AS i)"


@query(f"""
WITH {_T}, y AS (SELECT vec_id AS example_key, tok AS token_pos, [x[1] - 0.6 * a, x[2] - 0.8 * a, 0.0, x[4], x[5], x[6], x[7], x[8]] AS y
                 FROM (SELECT *, {_ALONG.format('x')} AS a FROM t)) {_OUT}
""")
def patch_project_out(spark, sf_dir):
    rows = tokened(spark, sf_dir).withColumn("values", patch.project_out(F.col("values"), _C))
    return elements(rows, "values", "example_key", "token_pos")


@query(f"""
WITH {_E}, m AS (SELECT d % 8 AS dim, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS raw FROM e GROUP BY ALL)
SELECT vec_id AS example_key, (d // 8)::INT AS token_pos, dim::INT AS dim, round_even(v + 0.5 * raw, 4) + 0 AS value FROM e JOIN m ON d % 8 = dim
""")
def patch_add_direction(spark, sf_dir):
    rows = tokened(spark, sf_dir)
    raw = represent.direction(rows, _POS, _NEG).select("raw_vector")
    return elements(rows.join(F.broadcast(raw)).withColumn("values", patch.add_direction(F.col("values"), F.col("raw_vector"), 0.5)), "values", "example_key", "token_pos")


_MEANS = "m AS (SELECT vec_id, d % 8 AS dim, avg(v) AS m FROM e GROUP BY ALL)"


def _with_donor(spark, sf_dir, donor=True):
    """Token rows with the mean of their own example and that of their donor, the example whose key is one less."""
    rows = tokened(spark, sf_dir)
    means = mean_vectors(rows, ["example_key"], "values").select("example_key", F.col("values").alias("own_mean"))
    donors = means.select((F.col("example_key") + 1).alias("example_key"), F.col("own_mean").alias("donor_mean"))
    own = rows.join(means, "example_key")
    return own.join(donors, "example_key") if donor else own


@query(f"""
WITH {_E}, {_MEANS}
SELECT e.vec_id AS example_key, (d // 8)::INT AS token_pos, (d % 8)::INT AS dim, round_even(v + b.m - a.m, 4) + 0 AS value
FROM e JOIN m a ON a.vec_id = e.vec_id AND a.dim = d % 8 JOIN m b ON b.vec_id = e.vec_id - 1 AND b.dim = d % 8
""")
def patch_swap_mean(spark, sf_dir):
    rows = _with_donor(spark, sf_dir).withColumn("values", patch.swap_mean(F.col("values"), F.col("donor_mean"), F.col("own_mean")))
    return elements(rows, "values", "example_key", "token_pos")


@query(f"""
WITH {_E}, {_MEANS}, p AS (SELECT vec_id, sum(CASE dim WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 ELSE 0 END * m) AS a, sum(CASE dim WHEN 2 THEN m ELSE 0 END) AS b FROM m GROUP BY ALL)
SELECT e.vec_id AS example_key, (d // 8)::INT AS token_pos, (d % 8)::INT AS dim,
  round_even(v + CASE d % 8 WHEN 0 THEN 0.6 * (q.a - p.a) WHEN 1 THEN 0.8 * (q.a - p.a) WHEN 2 THEN q.b - p.b ELSE 0 END, 4) + 0 AS value
FROM e JOIN p ON p.vec_id = e.vec_id JOIN p q ON q.vec_id = e.vec_id - 1
""")
def patch_swap_components(spark, sf_dir):
    rows = _with_donor(spark, sf_dir).withColumn("values", patch.swap_components(F.col("values"), F.col("donor_mean"), F.col("own_mean"), _C))
    return elements(rows, "values", "example_key", "token_pos")


@query(f"""
WITH {_E} SELECT a.vec_id AS example_key, (a.d // 8)::INT AS token_pos, (a.d % 8)::INT AS dim, round_even(b.v, 4) + 0 AS value
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.d = a.d
""")
def patch_interchange(spark, sf_dir):
    rows = tokened(spark, sf_dir)
    pairs = vectors(spark, sf_dir).select(F.col("example_key").alias("target_key"), (F.col("example_key") + 1).alias("donor_key"))
    return elements(patch.interchange(rows, rows, pairs), "values", "example_key", "token_pos")


@query(f"""
WITH {_E}, {_MEANS}
SELECT e.vec_id AS example_key, (d // 8)::INT AS token_pos, (d % 8)::INT AS dim, round_even(v + 0.25 * (b.m - a.m), 4) + 0 AS value
FROM e JOIN m a ON a.vec_id = e.vec_id AND a.dim = d % 8 JOIN m b ON b.vec_id = e.vec_id - 1 AND b.dim = d % 8
""")
def patch_residual_path(spark, sf_dir):
    rows = _with_donor(spark, sf_dir).withColumn("values", patch.residual_path(F.col("values"), F.col("donor_mean"), F.col("own_mean"), 0.5, 0.5))
    return elements(rows, "values", "example_key", "token_pos")


@query(f"""
WITH {_T}, s AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS before, {_ALONG.format('x')} AS a, x[3] AS b FROM t)
SELECT vec_id AS example_key, count(*) AS tokens, round_even(avg(before), 4) + 0 AS norm_before,
  round_even(avg(sqrt(greatest(before * before - a * a - b * b, 0))), 4) + 0 AS norm_after, round_even(sqrt(sum(a * a + b * b)), 4) + 0 AS delta_norm FROM s GROUP BY vec_id
""")
def patch_stats(spark, sf_dir):
    rows = tokened(spark, sf_dir).withColumn("after", patch.project_out(F.col("values"), _C))
    found = patch.patch_stats(rows, ["example_key"], "values", "after")
    return found.select("example_key", "tokens", *(rounded(F.col(c)).alias(c) for c in ("norm_before", "norm_after", "delta_norm")))


@query("""
WITH c AS (SELECT vec_id % 97 AS case_id, count(*) FILTER (label = 0) AS t, count(*) FILTER (label = 1) AS d,
                  max(vec_id) FILTER (label = 0) AS tk, max(vec_id) FILTER (label = 1) AS dk FROM embeddings GROUP BY ALL),
r AS (SELECT *, CASE WHEN t = 0 THEN 'no target' WHEN d = 0 THEN 'no donor' WHEN t > 1 THEN 'several targets' WHEN d > 1 THEN 'several donors' END AS reason FROM c)
SELECT case_id, CASE WHEN reason IS NULL THEN tk END AS target_key, CASE WHEN reason IS NULL THEN dk END AS donor_key,
       CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason FROM r
""")
def patch_pairing(spark, sf_dir):
    return patch.pair_cases(vectors(spark, sf_dir).withColumn("case_id", F.col("example_key") % 97), "case_id", _POS, _NEG)


@query(f"""
WITH {_UNITS}, b AS (SELECT vec_id, score FROM s WHERE layer = 0), v AS (SELECT vec_id + 1 AS vec_id, score FROM s WHERE layer = 1)
SELECT coalesce(b.vec_id, v.vec_id) AS example_key, round_even(v.score - b.score, 4) + 0 AS delta_score,
       CASE WHEN b.vec_id IS NULL OR v.vec_id IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM b FULL JOIN v USING (vec_id)
""")
def patch_compare(spark, sf_dir):
    """Each vector against its predecessor: the first and the one after the last have one side only."""
    scored = _layer_scores(spark, sf_dir)
    base, variant = scored.where("layer = 0"), scored.where("layer = 1").withColumn("example_key", F.col("example_key") + 1)
    found = patch.compare(base, variant, "example_key", ["score"])
    ok = F.coalesce(F.col("status"), F.lit("skipped"))
    return found.select("example_key", rounded(F.col("delta_score")).alias("delta_score"), ok.alias("status"))


@query(f"""
WITH {_E}, m AS (SELECT label, d, avg(v) AS v FROM e GROUP BY ALL)
SELECT a.label AS left_label, b.label AS right_label, round_even(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 4) + 0 AS cosine
FROM m a JOIN m b ON a.d = b.d AND a.label < b.label GROUP BY ALL
""")
def rd_cosine_pairs(spark, sf_dir):
    c = mean_vectors(vectors(spark, sf_dir), ["label"], "values")
    pairs = pair_table(c, "label", "values")
    return pairs.select(F.col("a").alias("left_label"), F.col("b").alias("right_label"), rounded(F.col("cosine")).alias("cosine"))


@query(f"""
WITH {_E}, m AS (SELECT label AS concept, d, avg(v) AS v FROM e GROUP BY ALL),
n AS (SELECT concept, d, v - avg(v) OVER (PARTITION BY d) AS c FROM m),
s AS (SELECT vec_id, label, concept, sum(e.v * n.c) / sqrt(sum(n.c * n.c)) AS score FROM e JOIN n USING (d) GROUP BY ALL),
b AS (SELECT vec_id, label, arg_max(concept, round_even(score, 9) - concept * 1e-12) AS best FROM s GROUP BY ALL)
SELECT label, count(*) AS n, round_even(avg((best = label)::INT), 4) + 0 AS accuracy FROM b GROUP BY label
""")
def rd_top1_validation(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    space = represent.concept_space(rows, "label").select(F.col("label").cast("int").alias("concept"), "vector")
    scored = project.scores(rows, space)
    best = F.max_by("concept", F.bround("score", 9) - F.col("concept") * 1e-12)
    hits = scored.groupBy("example_key", "label").agg(best.alias("best"))
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("best") == F.col("label")).cast("int")).alias("a")).select("label", "n", rounded(F.col("a")).alias("accuracy"))


@query(f"""
WITH {_E}, n AS (SELECT vec_id, label, sqrt(sum(v * v)) AS norm FROM e GROUP BY ALL)
SELECT label, round_even(min(norm), 4) + 0 AS least, round_even(max(norm), 4) + 0 AS most, round_even(sum(norm * norm), 3) + 0 AS energy FROM n GROUP BY label
""")
def vec_norms(spark, sf_dir):
    v = vectors(spark, sf_dir).select("label", norm(F.col("values")).alias("norm"), dot(F.col("values"), F.col("values")).alias("sq"))
    return v.groupBy("label").agg(rounded(F.min("norm")).alias("least"), rounded(F.max("norm")).alias("most"), rounded(F.sum("sq"), 3).alias("energy"))


@query(f"""
WITH {_E} SELECT a.d::INT AS i, b.d::INT AS j, round_even(covar_pop(a.v, b.v), 6) + 0 AS covariance FROM e a JOIN e b USING (vec_id) GROUP BY ALL
""")
def rep_covariance(spark, sf_dir):
    """From the sums alone, so that nothing is collected."""
    found = represent.second_moments(vectors(spark, sf_dir))
    totals = found.select(F.col("i").alias("j"), F.col("total").alias("other"))
    listed = found.select("i", "n", "total", F.posexplode("products").alias("j", "p")).join(totals, "j")
    return listed.select("i", "j", rounded(F.col("p") / F.col("n") - F.col("total") * F.col("other") / F.col("n") / F.col("n"), 6).alias("covariance"))


_MEAN, _SPREAD = [0.1] * 8, [2.0] * 4 + [0.5] * 4
_LONG = "SELECT example_key, token_pos, dim, round_even(value, 4) + 0 AS value FROM y"
_STD = f"""{_E}, x AS (SELECT vec_id AS example_key, (d // 8)::INT AS token_pos, (d % 8)::INT AS dim, v, CASE WHEN d % 8 < 4 THEN 2.0 ELSE 0.5 END AS s FROM e),
  w AS (SELECT example_key, token_pos, sum(CASE dim WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 ELSE 0 END * (v - 0.1) / s) AS a, sum(CASE dim WHEN 2 THEN (v - 0.1) / s ELSE 0 END) AS b FROM x GROUP BY ALL)"""
_ALONG_STD = "CASE dim WHEN 0 THEN 0.6 * {0} WHEN 1 THEN 0.8 * {0} WHEN 2 THEN {1} ELSE 0 END * s"


@query(f"WITH {_STD}, y AS (SELECT example_key, token_pos, dim, v - 0.5 * {_ALONG_STD.format('a', 'b')} AS value FROM x JOIN w USING (example_key, token_pos)) {_LONG}")
def patch_project_rows(spark, sf_dir):
    rows = tokened(spark, sf_dir)
    values = F.col("values")
    return elements(rows.withColumn("values", patch.project_out_standardized(values, values, _C, _MEAN, _SPREAD, _SPREAD, 0.5)), "values", "example_key", "token_pos")


@query(f"""
WITH {_STD}, m AS (SELECT example_key, avg(a) AS a, avg(b) AS b FROM w GROUP BY ALL),
y AS (SELECT example_key, token_pos, dim, v - {_ALONG_STD.format('a', 'b')} AS value FROM x JOIN m USING (example_key)) {_LONG}
""")
def patch_project_section(spark, sf_dir):
    rows = _with_donor(spark, sf_dir, donor=False)
    return elements(rows.withColumn("values", patch.project_out_standardized(F.col("values"), F.col("own_mean"), _C, _MEAN, _SPREAD, _SPREAD)), "values", "example_key", "token_pos")


@query(f"WITH {_STD}, y AS (SELECT example_key, token_pos, dim, v + 0.5 * (dim + 1) / 10.0 * s AS value FROM x) {_LONG}")
def patch_add_standardized(spark, sf_dir):
    direction = [(d + 1) / 10 for d in range(8)]
    return elements(tokened(spark, sf_dir).withColumn("values", patch.add_standardized(F.col("values"), direction, _SPREAD, 0.5)), "values", "example_key", "token_pos")


@query(f"""
WITH {_STD}, m AS (SELECT example_key, avg(a) AS a, avg(b) AS b FROM w GROUP BY ALL),
y AS (SELECT x.example_key, token_pos, dim, v + {_ALONG_STD.format('(q.a - p.a)', '(q.b - p.b)')} AS value FROM x JOIN m p ON p.example_key = x.example_key JOIN m q ON q.example_key = x.example_key - 1) {_LONG}
""")
def patch_swap_standardized(spark, sf_dir):
    rows = _with_donor(spark, sf_dir)
    return elements(rows.withColumn("values", patch.swap_standardized(F.col("values"), F.col("donor_mean"), F.col("own_mean"), _C, _MEAN, _SPREAD, _SPREAD)), "values", "example_key", "token_pos")


@query(f"""
WITH {_E}, {_MEANS}
SELECT e.vec_id AS example_key, (d // 8)::INT AS token_pos, (d % 8)::INT AS dim, round_even(v + 0.25 * (b.m - v), 4) + 0 AS value
FROM e JOIN m b ON b.vec_id = e.vec_id - 1 AND b.dim = d % 8
""")
def patch_delta_transport(spark, sf_dir):
    rows = _with_donor(spark, sf_dir)
    return elements(rows.withColumn("values", patch.delta_transport(F.col("values"), F.col("donor_mean"), F.col("values"), 0.5, 0.5)), "values", "example_key", "token_pos")


@query()
def patch_random_control(spark, sf_dir):
    random = patch.random_components(2, 8, 42)
    values = F.col("values")
    return elements(tokened(spark, sf_dir).withColumn("values", patch.random_control(values, values, _C, random, _MEAN, _SPREAD, _SPREAD)), "values", "example_key", "token_pos")


@query("""
WITH e AS (SELECT DISTINCT l_linenumber AS w, l_suppkey % 5 AS r, l_partkey % 3 AS p FROM lineitem)
SELECT w AS write_layer, count(*) AS n_edges, string_agg(r || ':' || p, ',' ORDER BY r, p) AS edges FROM e GROUP BY w
""")
def patch_path_mask(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("write_layer"), (F.col("l_suppkey") % 5).alias("read_layer"), (F.col("l_partkey") % 3).alias("position"))
    text = F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["read_layer"].cast("string"), e["position"].cast("string"))), ",")
    return patch.path_mask(edges).select("write_layer", "n_edges", text.alias("edges"))


@query(f"WITH {_E} SELECT vec_id AS example_key, (d // 16)::INT AS layer, round_even(sum(v), 4) + 0 AS total FROM e WHERE d // 16 IN (1, 3) AND label < 5 GROUP BY ALL")
def patch_activation_bank(spark, sf_dir):
    rows = layered(spark, sf_dir)
    found = patch.activation_bank(rows, [1, 3], vectors(spark, sf_dir).where("label < 5").select("example_key"))
    return found.select("example_key", F.col("layer").cast("int").alias("layer"), rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""
SELECT l_linenumber AS write_layer, (l_linenumber % 4)::INT AS source_layer, CASE WHEN l_linenumber % 4 = 3 THEN 'missing_layer' WHEN l_linenumber % 4 = 2 AND l_linenumber < 6 THEN 'missing_component' END AS reason,
       CASE WHEN l_linenumber % 4 < 2 OR (l_linenumber % 4 = 2 AND l_linenumber >= 6) THEN CASE WHEN l_linenumber >= 6 THEN 0.0 ELSE 1.0 END END AS first
FROM (SELECT DISTINCT l_linenumber FROM lineitem)
""")
def patch_operands(spark, sf_dir):
    """Layers from 6 on take the raw vector, others the component a, which layer 2 lacks; layer 3 is not there at all."""
    layer = F.col("l_linenumber")
    writes = table(spark, sf_dir, "lineitem").select(layer.alias("write_layer"), (layer % 4).cast("int").alias("source_layer"), F.when(layer < 6, "a").alias("component")).distinct()
    sources = spark.range(3).select(F.col("id").cast("int").alias("source_layer"), F.array(F.lit(0.0)).alias("raw"))
    components = spark.range(2).select(F.col("id").cast("int").alias("source_layer"), F.lit("a").alias("component"), F.array(F.lit(1.0)).alias("vector"))
    found = patch.resolved_operands(writes, sources, components)
    return found.select("write_layer", "source_layer", "reason", F.get("vector", F.lit(0)).alias("first"))


@query(f"""
WITH {_E} SELECT vec_id AS example_key, (d // 8)::INT AS token_pos, round_even(sum(v), 4) + 0 AS total FROM e WHERE d // 8 >= 5 AND d // 8 < 7 GROUP BY ALL
""")
def tok_negative_slice(spark, sf_dir):
    rows = tokens.slice_tokens(tokened(spark, sf_dir), -3, -1)
    return rows.select("example_key", "token_pos", rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {_SECTIONS} SELECT vec_id AS example_key, section, 0 AS token_pos, count(DISTINCT pos) AS overlap FROM sec GROUP BY ALL")
def tok_pooled_sections(spark, sf_dir):
    return tokens.pooled_sections(_sections(spark, sf_dir))


@query(f"""
WITH {_E}, n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM e GROUP BY vec_id)
SELECT 'v' || vec_id AS coordinate, 0 AS layer, d::INT AS dim, round_even(v / norm, 4) + 0 AS value, round_even(norm, 4) + 0 AS norm FROM e JOIN n USING (vec_id)
""")
def rep_array_import(spark, sf_dir):
    """Each vector as an array file, read as a coordinate."""
    files = vectors(spark, sf_dir).select(F.format_string("in/v%d.npy", "example_key").alias("path"), arrays.npy_bytes(F.col("values")).alias("content"))
    found = arrays.coordinates(arrays.arrays(files))
    return elements(found.withColumn("norm", rounded(F.col("norm"))), "vector", "coordinate", "layer", "norm")


@query(f"""
WITH {_E}, m AS (SELECT d // 16 AS layer, label, d % 16 AS dim, avg(v) AS v, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT layer, label, dim, v - avg(v) OVER (PARTITION BY layer, dim) AS raw FROM m WHERE n >= 5),
p AS (SELECT *, CASE WHEN layer = 1 THEN (sum(raw) FILTER (dim < 2) OVER (PARTITION BY layer, label)) / 2 ELSE 0 END AS along FROM r)
SELECT layer::INT AS layer, label::VARCHAR AS label, dim::INT AS dim, round_even(raw - CASE WHEN dim < 2 THEN along ELSE 0 END, 4) + 0 AS value FROM p
""")
def rep_neutral_space(spark, sf_dir):
    """Layer 1 without its part along the sum of the first two dimensions."""
    neutral = {1: [[0.5**0.5, 0.5**0.5] + [0.0] * 14]}
    space = represent.concept_space(layered(spark, sf_dir), "label", 5, ["layer"], neutral)
    return elements(space, "raw_vector", "layer", "label")


@query("SELECT label::VARCHAR AS label, count(*) AS count FROM embeddings GROUP BY label HAVING count(*) < 52")
def rep_dropped_concepts(spark, sf_dir):
    return represent.dropped_concepts(vectors(spark, sf_dir), "label", 52)


@query(f"""
WITH {_E}, t AS (SELECT vec_id, d // 8 AS p, d % 8 AS dim, v FROM e), w(place, p) AS (VALUES (0, 6), (1, 2), (2, 6))
SELECT vec_id AS example_key, 'mean' AS how, dim::INT AS dim, round_even(avg(v), 4) + 0 AS value, 3 AS n_tokens FROM t JOIN w USING (p) GROUP BY ALL
UNION ALL SELECT vec_id, 'first', dim::INT, round_even(v, 4) + 0, 3 FROM t WHERE p = 6
""")
def tok_given_positions(spark, sf_dir):
    """Positions 6, 2, 6 in this order."""
    tokens_ = tokened(spark, sf_dir)
    places = F.posexplode(F.array(*map(F.lit, (6, 2, 6)))).alias("place", "token_pos")
    listed = vectors(spark, sf_dir).select("example_key", places)
    found = [elements(tokens.pool_positions(tokens_, listed, ["example_key"], how).withColumn("how", F.lit(how)), "values", "example_key", "how", "n_tokens") for how in ("mean", "first")]
    return found[0].unionByName(found[1])
