"""Queries on summaries behind reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import mean_vectors, rounded
from tessera.operators import geometry
from tessera.operators import readouts as rd
from tessera.operators import reports as rp
from tessera.operators import represent
from tessera.plans.features import _E, layered, vectors
from tessera.plans.readouts import _P, _scored
from tessera.plans.registry import query, table
from tessera.sources import imports

_LAYERED = f"{_E}, l AS (SELECT vec_id, label, d // 16 AS layer, d % 16 AS d, v FROM e)"
_LAYER_MEANS = f"{_LAYERED}, m AS (SELECT layer, label, d, avg(v) AS v FROM l GROUP BY ALL)"
_LAYER_PAIRS = f"""{_LAYER_MEANS}, c AS (SELECT x.layer, x.label AS a, y.label AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS cosine
  FROM m x JOIN m y ON x.layer = y.layer AND x.d = y.d AND x.label < y.label GROUP BY ALL)"""
_PAIRS = f"""{_E}, m AS (SELECT label, d, avg(v) AS v FROM e GROUP BY ALL),
  c AS (SELECT x.label AS a, y.label AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS cosine FROM m x JOIN m y ON x.d = y.d AND x.label < y.label GROUP BY ALL)"""


def _layer_pairs(spark, sf_dir):
    return rp.pair_table(mean_vectors(layered(spark, sf_dir), ["layer", "label"], "values"), "label", "values", ["layer"])


def _pairs(spark, sf_dir):
    return rp.pair_table(mean_vectors(vectors(spark, sf_dir), ["label"], "values"), "label", "values")


@query(f"""
WITH {_P}, c AS (SELECT fold, true_label, count(*) AS n, count(*) FILTER (true_label = predicted_label) AS r FROM p GROUP BY ALL),
m AS (SELECT fold, round_even(avg(r / n), 4) + 0 AS balanced_accuracy FROM c GROUP BY fold)
SELECT fold, balanced_accuracy FROM m ORDER BY balanced_accuracy DESC, fold LIMIT 1
""")
def rd_best_layer(spark, sf_dir):
    found = rd.accuracy(_scored(spark, sf_dir), ["fold"]).select("fold", rounded(F.col("balanced_accuracy")).alias("balanced_accuracy"))
    return rp.best(found, "balanced_accuracy", ["fold"])


_METRICS = "CASE WHEN event_type = 'view' THEN 'skipped' ELSE 'ok' END AS status"


@query(f"""
WITH r AS (SELECT {_METRICS}, value, (event_type = 'click')::INT::DOUBLE AS is_click FROM events)
SELECT 'value' AS metric, round_even(avg(value), 4) + 0 AS mean, count(value) AS n FROM r WHERE status = 'ok'
UNION ALL SELECT 'is_click', round_even(avg(is_click), 4) + 0, count(is_click) FROM r WHERE status = 'ok'
""")
def patch_comparison_means(spark, sf_dir):
    found = rp.mean_metrics(_compared(spark, sf_dir), "status", "metrics")
    return found.select("metric", rounded(F.col("mean")).alias("mean"), "n")


def _compared(spark, sf_dir):
    metrics = F.create_map(F.lit("value"), F.col("value"), F.lit("is_click"), (F.col("event_type") == "click").cast("int").cast("double"))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("status"), metrics.alias("metrics"))


@query("SELECT count(*) FILTER (event_type <> 'view') AS n_compared, count(*) FILTER (event_type = 'view') AS n_skipped FROM events")
def patch_comparison_counts(spark, sf_dir):
    return rp.compared_counts(_compared(spark, sf_dir), "status")


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, 6 AS e FROM conversations GROUP BY conv_id)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_prompts, count(*) FILTER (n >= e) AS n_complete, sum(greatest(e - n, 0))::BIGINT AS n_missing FROM c
""")
def gen_import_summary(spark, sf_dir):
    return rp.import_summary(table(spark, sf_dir, "conversations").withColumn("expected", F.lit(6)), "conv_id", "expected")


@query("""
SELECT lang, count(*) AS count, count(*) FILTER (length(trim(text)) > 0) AS n_nonempty, sum(n_chars)::BIGINT AS tokens_sum, min(n_chars) AS tokens_min, max(n_chars) AS tokens_max,
       round_even(avg(n_chars), 4) + 0 AS tokens_mean FROM documents GROUP BY lang
""")
def gen_summary(spark, sf_dir):
    return rp.generation_summary(table(spark, sf_dir, "documents"), "text", "n_chars", ["lang"]).withColumn("tokens_mean", rounded(F.col("tokens_mean")))


@query("SELECT lang, coalesce(source, 'null') AS value, count(*) AS count FROM documents GROUP BY ALL")
def gen_histogram(spark, sf_dir):
    return rp.histogram(table(spark, sf_dir, "documents"), "source", ["lang"])


@query("SELECT doc_id, sha256(text) AS output_sha256 FROM documents")
def gen_output_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("output_sha256"))


@query("""
SELECT user_id, round_even(CASE WHEN sum(s) = 0 THEN 0 ELSE sum(event_id) / sum(s) END, 4) + 0 AS tokens_per_second
FROM (SELECT user_id, event_id, CASE WHEN user_id % 7 = 0 THEN 0 ELSE event_id % 13 + 1 END AS s FROM events) GROUP BY user_id
""")
def gen_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("user_id") % 7 == 0, 0).otherwise(F.col("event_id") % 13 + 1))
    return rp.throughput(rows, "event_id", "s", ["user_id"]).withColumn("tokens_per_second", rounded(F.col("tokens_per_second")))


@query("SELECT o_custkey AS key FROM orders WHERE o_custkey IS NOT NULL UNION SELECT c_custkey FROM customer")
def rep_coverage(spark, sf_dir):
    return rp.key_union(_keyed(spark, sf_dir), "key")


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def ds_common_keys(spark, sf_dir):
    return rp.key_intersection(_keyed(spark, sf_dir), "key")


def _keyed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return [orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))]


@query("""
WITH s AS (SELECT user_id, event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(CASE event_type WHEN 'click' THEN -1 ELSE 1 END) AS expected FROM events GROUP BY ALL)
SELECT event_type, count(*) AS n, count(*) FILTER (sign(last - first) = expected) AS n_passed FROM s GROUP BY event_type
""")
def view_direction_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("expected", F.when(F.col("event_type") == "click", -1).otherwise(1))
    checks = rp.direction_checks(rows, ["user_id", "event_type"], "event_id", "value", "expected")
    return checks.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query("""
WITH s AS (SELECT conv_id, coalesce(arg_min(length(text), turn) FILTER (role = 'system'), arg_min(length(text), turn)) AS baseline,
                  coalesce(arg_min(length(text), turn) FILTER (role = 'assistant'), arg_max(length(text), turn)) AS target FROM conversations GROUP BY conv_id)
SELECT conv_id, baseline, target, target - baseline AS delta FROM s
""")
def view_role_contrast(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    return rp.role_contrast(rows, "conv_id", "role", "turn", "n", "system", "assistant")


@query("""
WITH r AS (SELECT l_suppkey, l_shipmode, l_returnflag, max(l_quantity) AS q FROM (SELECT l_suppkey, l_linenumber AS l_shipmode, l_returnflag, l_quantity FROM lineitem) GROUP BY ALL)
SELECT a.l_suppkey, a.l_shipmode AS l_linenumber, round_even(b.q - a.q, 2) + 0 AS delta FROM r a JOIN r b USING (l_suppkey, l_shipmode) WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R'
""")
def view_paired_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    found = rp.paired_deltas(rows, ["l_suppkey", "l_linenumber"], "l_returnflag", "q", "N", "R")
    return found.withColumn("delta", F.bround("delta", 2) + F.lit(0.0))


@query(f"WITH {_PAIRS} SELECT a, b, round_even(cosine, 4) + 0 AS cosine FROM c ORDER BY c.cosine DESC, a, b LIMIT 5")
def view_nearest_pairs(spark, sf_dir):
    return rp.extreme_pairs(_pairs(spark, sf_dir), 5).withColumn("cosine", rounded(F.col("cosine")))


@query(f"WITH {_PAIRS} SELECT a, b, round_even(cosine, 4) + 0 AS cosine FROM c ORDER BY c.cosine, a, b LIMIT 5")
def view_opposite_pairs(spark, sf_dir):
    return rp.extreme_pairs(_pairs(spark, sf_dir), 5, opposite=True).withColumn("cosine", rounded(F.col("cosine")))


@query("""
(SELECT 'low' AS "end", doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 4)
UNION ALL (SELECT 'high', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 4)
""")
def view_extremes(spark, sf_dir):
    return rp.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 4)


@query(f"""
WITH {_PAIRS}, s AS (SELECT a % 3 AS ca, b % 3 AS cb, cosine FROM c),
u AS (SELECT ca AS cluster, ca = cb AS same, cosine FROM s UNION ALL SELECT cb, false, cosine FROM s WHERE ca <> cb),
z AS (SELECT label % 3 AS cluster, count(DISTINCT label) AS size FROM embeddings GROUP BY 1)
SELECT cluster, round_even(avg(cosine) FILTER (same), 4) + 0 AS within, round_even(avg(cosine) FILTER (NOT same), 4) + 0 AS between,
       round_even(avg(cosine) FILTER (same) - avg(cosine) FILTER (NOT same), 4) + 0 AS separation, max(size) AS size FROM u JOIN z USING (cluster) GROUP BY cluster
""")
def rep_cluster_alignment(spark, sf_dir):
    clusters = table(spark, sf_dir, "embeddings").select(F.col("label").alias("name"), (F.col("label") % 3).alias("cluster")).distinct()
    found = rp.cluster_alignment(_pairs(spark, sf_dir), clusters)
    return found.select("cluster", *(rounded(F.col(c)).alias(c) for c in ("within", "between", "separation")), "size")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
h AS (SELECT sum(n * (n - 1) / 2) AS h FROM c), f AS (SELECT sum(n * (n - 1) / 2) AS f FROM (SELECT sum(n) AS n FROM c GROUP BY source)), t AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY lang))
SELECT round_even((h / f)::DOUBLE, 4) + 0 AS precision, round_even((h / t)::DOUBLE, 4) + 0 AS recall FROM h, f, t
""")
def view_same_cluster(spark, sf_dir):
    found = rp.same_cluster_scores(table(spark, sf_dir, "documents"), "source", "lang")
    return found.select(rounded(F.col("precision").cast("double")).alias("precision"), rounded(F.col("recall").cast("double")).alias("recall"))


_SIMILAR = f"""{_LAYER_PAIRS}, s AS (SELECT x.layer AS layer_a, y.layer AS layer_b, corr(x.cosine, y.cosine) AS similarity FROM c x JOIN c y USING (a, b) GROUP BY ALL)"""


@query(f"WITH {_SIMILAR} SELECT layer_a, layer_b, round_even(similarity, 4) + 0 AS similarity FROM s")
def rep_layer_similarity(spark, sf_dir):
    return rp.layer_similarity(_layer_pairs(spark, sf_dir), "layer").withColumn("similarity", rounded(F.col("similarity")))


@query(f"WITH {_SIMILAR} SELECT round_even(avg(similarity), 4) + 0 AS similarity FROM s WHERE layer_b = layer_a + 1")
def rep_adjacent_layers(spark, sf_dir):
    found = rp.adjacent_mean(rp.layer_similarity(_layer_pairs(spark, sf_dir), "layer"))
    return found.select(rounded(F.col("similarity")).alias("similarity"))


@query("""
WITH l AS (SELECT DISTINCT l_linenumber AS layer FROM lineitem), t AS (SELECT layer, ntile(4) OVER (ORDER BY layer) AS t FROM l)
SELECT layer, ['Early', 'Early-Mid', 'Mid-Late', 'Late'][t] AS "group", min(layer) OVER (PARTITION BY t) || '-' || max(layer) OVER (PARTITION BY t) AS range FROM t
""")
def view_layer_groups(spark, sf_dir):
    return rp.layer_groups(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("layer")))


@query(f"""
WITH {_E}, m AS (SELECT label % 3 AS g, d, avg(v) AS v, count(*) AS size FROM e GROUP BY ALL)
SELECT a.g AS "group", b.g AS other, round_even(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 4) + 0 AS cosine, max(a.size) AS size FROM m a JOIN m b USING (d) GROUP BY ALL
""")
def rep_anchor_geometry(spark, sf_dir):
    anchors = table(spark, sf_dir, "embeddings").select("label", (F.col("label") % 3).alias("group")).distinct()
    return rp.anchor_geometry(vectors(spark, sf_dir), anchors, "label", "values").withColumn("cosine", rounded(F.col("cosine")))


@query(f"""
WITH {_LAYER_MEANS}, f AS (SELECT layer, label, d, v * 0.5 * CASE layer WHEN 3 THEN 1.0 ELSE 2.0 + layer END AS v FROM m),
n AS (SELECT layer, label, sqrt(sum(v * v)) AS norm FROM f GROUP BY ALL)
SELECT layer, label, d::INT AS dim, round_even(v, 4) + 0 AS raw, round_even(v / norm, 4) + 0 AS value FROM f JOIN n USING (layer, label)
""")
def rep_direction_export(spark, sf_dir):
    means = mean_vectors(layered(spark, sf_dir), ["layer", "label"], "values")
    norms = spark.range(3).select(F.col("id").cast("int").alias("layer"), (F.col("id") + 2.0).alias("residual_norm"))
    found = rp.exported_direction(means, "values", 0.5, norms)
    listed = found.select("layer", "label", F.posexplode(F.arrays_zip("raw_vector", "values")).alias("dim", "x"))
    return listed.select("layer", "label", "dim", rounded(F.col("x.raw_vector")).alias("raw"), rounded(F.col("x.values")).alias("value"))


@query("""
WITH s AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, min(event_id) AS event_id FROM s GROUP BY ALL
""")
def ds_merge_shards(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    shards = [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")]
    return rp.merge_shards(shards, ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def ds_keep_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rp.merge_shards([events], ["user_id", "event_type"], [F.col("event_id")], last=True)


@query("""
SELECT l_orderkey, sum(l_quantity)::DOUBLE AS quantity, round_even(sqrt(sum(l_discount * l_discount)), 4) + 0 AS delta,
       CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN max(l_tax) - min(l_tax) <= 0.01 THEN round_even(min(l_tax), 4) + 0 END AS tax FROM lineitem GROUP BY l_orderkey
""")
def patch_rollup(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("double").alias("quantity"),
        rounded(F.sqrt(F.sum(F.col("l_discount") * F.col("l_discount")))).alias("delta"),
        rp.if_identical("l_returnflag").alias("flag"),
        rounded(rp.if_identical("l_tax", 0.01)).alias("tax"),
    )
    return found


@query("""
WITH d AS (SELECT coalesce(source, 'none') AS source, doc_id, n_chars FROM documents), n AS (SELECT count(DISTINCT source) AS g FROM d), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id)::INT AS rank FROM d)
SELECT source, doc_id, rank FROM r, n WHERE rank <= ceil(45 / g) ORDER BY rank, source LIMIT 45
""")
def ds_interleaved(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    return rp.capped_interleaved(docs, "source", [F.col("n_chars"), F.col("doc_id")], 45).select("source", "doc_id", "rank")


@query("""
SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS begin, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS "end" FROM conversations
""")
def tok_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return rp.running_offsets(rows, ["conv_id"], "turn", "n").select("conv_id", "turn", "begin", "end")


@query("SELECT user_id, coalesce(event_type, 'none') AS metric, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def cat_merged_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("metrics", F.create_map(F.coalesce("event_type", F.lit("none")), "value"))
    merged = rp.merged_maps(events, ["user_id"], "event_id", "metrics")
    return merged.select("user_id", F.explode("metrics").alias("metric", "value"))


@query(f"""
WITH {_P}, f AS (SELECT fold, avg((true_label = predicted_label)::INT) AS a, avg(true_label) AS b FROM p GROUP BY fold)
SELECT fold, round_even(a, 4) + 0 AS raw_accuracy, round_even(b, 4) + 0 AS null_accuracy, round_even(a - b, 4) + 0 AS delta_raw_minus_null_accuracy FROM f
""")
def view_flat_metrics(spark, sf_dir):
    right = F.avg((F.col("true_label") == F.col("predicted_label")).cast("int"))
    nested = _scored(spark, sf_dir).groupBy("fold").agg(right.alias("_a"), F.avg("true_label").alias("_b")).select(
        "fold", F.struct(F.col("_a").alias("accuracy")).alias("raw"), F.struct(F.col("_b").alias("accuracy")).alias("null"),
        F.struct((F.col("_a") - F.col("_b")).alias("accuracy")).alias("delta"),
    )
    flat = rp.flattened(nested, {"raw": "raw_", "null": "null_", "delta": "delta_raw_minus_null_"})
    return flat.select("fold", *(rounded(F.col(c)).alias(c) for c in flat.columns if c != "fold"))


@query(f"""
WITH {_E}, m AS (SELECT label AS concept, d, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT concept, d, v - avg(v) OVER (PARTITION BY d) AS c FROM m),
s AS (SELECT vec_id, label, concept, sum(e.v * n.c) / sqrt(sum(n.c * n.c)) AS score FROM e JOIN n USING (d) GROUP BY ALL),
b AS (SELECT vec_id, label, arg_max(concept, round_even(score, 9) - concept * 1e-12) AS best FROM s GROUP BY ALL)
SELECT best AS predicted, count(*) AS n, count(*) FILTER (best = label) AS n_right, round_even(1.0 / (SELECT count(DISTINCT label) FROM embeddings), 4) + 0 AS chance FROM b GROUP BY best
""")
def rd_predicted_counts(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    means = represent.concept_space(rows, "label").select(F.col("label").cast("int").alias("concept"), "vector")
    return rd.predicted_counts(rows, means).withColumn("chance", rounded(F.col("chance")))


@query("""
SELECT a.user_id, a.event_type, round_even(a.v, 4) + 0 AS "left", round_even(b.v, 4) + 0 AS "right"
FROM (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL) a JOIN (SELECT user_id, event_type, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL) b USING (user_id, event_type)
""")
def tok_common_positions(spark, sf_dir):
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    best = lambda rows: rows.groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    events = table(spark, sf_dir, "events")
    found = geometry.common_positions(best(events.where(early)), best(events.where(~early)), ["user_id", "event_type"])
    return found.select("user_id", "event_type", rounded(F.col("left")).alias("left"), rounded(F.col("right")).alias("right"))


@query("SELECT DISTINCT l_linenumber AS write_layer, CASE l_linenumber WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE l_linenumber END AS source_layer FROM lineitem")
def patch_layer_map(spark, sf_dir):
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("write_layer")).distinct()
    return geometry.mapped_layers(writes, {2: 0, 5: 1})


@query(f"WITH {_LAYERED} SELECT layer, count(DISTINCT vec_id) AS n, round_even(sum(v), 3) + 0 AS total FROM l WHERE layer IN (1, 2) GROUP BY layer")
def rep_layers(spark, sf_dir):
    rows = geometry.layers_among(layered(spark, sf_dir), [1, 2, 9])
    return rows.groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), rounded(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"))


@query("SELECT doc_id::VARCHAR AS example_key, lang AS value FROM documents")
def ds_label_values(spark, sf_dir):
    return imports.label_values(table(spark, sf_dir, "documents"), "doc_id", "lang")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'given' ELSE role END AS role, turn::VARCHAR AS turn_text FROM conversations")
def sec_merged_metadata(spark, sf_dir):
    built = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    explicit = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("role"), F.lit("given")))
    rows = table(spark, sf_dir, "conversations").withColumn("m", imports.merged_metadata(built, explicit))
    return rows.select("conv_id", "turn", F.element_at("m", "role").alias("role"), F.element_at("m", "turn").alias("turn_text"))


@query()
def rep_kmeans(spark, sf_dir):
    means = mean_vectors(vectors(spark, sf_dir), ["label"], "values")
    return geometry.kmeans(means, "label", "values", 3)


@query()
def rep_without_neutral(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    parts = geometry.neutral_components(rows.where("label = 9"), 0.5)
    means = represent.concept_space(geometry.without_neutral(rows, parts), "label")
    return means.select("label", rounded(F.col("norm")).alias("norm"), "count")
