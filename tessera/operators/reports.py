"""Summaries behind reports: tallies, contrasts, comparisons of clusters and layers, and merges of partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_or_null, mean_vectors, scale, unit

#: Tiles of points in a table of pairs.
_TILES = 8


def best(rows: DataFrame, metric: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The row of each group with the greatest metric; the first in order of equal ones, none where all are null."""
    first = F.struct((-F.col(metric)).alias("_m"), *order)
    found = F.min_by(F.struct(*rows.columns), first)
    return rows.where(F.col(metric).isNotNull()).groupBy(*keys).agg(found.alias("_r")).where("_r is not null").select("_r.*")


def mean_metrics(rows: DataFrame, status: str, metrics: str) -> DataFrame:
    """(metric, mean, n): the mean over rows with status "ok" of each entry of a map of metrics; a boolean is 0 or 1."""
    listed = rows.where(F.col(status) == "ok").select(F.explode(metrics).alias("metric", "value")).where("value is not null")
    return listed.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def compared_counts(rows: DataFrame, status: str) -> DataFrame:
    """One row: n_compared and n_skipped."""
    return rows.agg(F.count_if(F.col(status) == "ok").alias("n_compared"), F.count_if(~F.coalesce(F.col(status) == "ok", F.lit(False))).alias("n_skipped"))


def import_summary(rows: DataFrame, prompt: str, expected: str) -> DataFrame:
    """One row: n_rows, n_prompts, n_complete (prompts with as many rows as expected), n_missing (rows that lack)."""
    per = rows.groupBy(prompt).agg(F.count("*").alias("n"), F.max(expected).alias("e"))
    lack = F.greatest(F.col("e") - F.col("n"), F.lit(0))
    return per.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_prompts"), F.count_if(lack == 0).alias("n_complete"), F.sum(lack).cast("long").alias("n_missing")
    )


def generation_summary(rows: DataFrame, output: str, tokens: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, n_nonempty, and the sum, least, greatest and mean of the tokens."""
    filled = F.coalesce(F.length(F.trim(output)) > 0, F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.count_if(filled).alias("n_nonempty"), F.sum(tokens).alias("tokens_sum"), F.min(tokens).alias("tokens_min"),
        F.max(tokens).alias("tokens_max"), F.avg(tokens).alias("tokens_mean"),
    )


def histogram(rows: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each value of the label, as text; a null is "null"."""
    return rows.groupBy(*keys, F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("count"))


def throughput(rows: DataFrame, tokens: str, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    """tokens_per_second: all tokens over all seconds, 0 where there are no seconds."""
    ratio = F.coalesce(F.try_divide(F.sum(tokens), F.sum(seconds)), F.lit(0.0))
    return rows.groupBy(*keys).agg(ratio.cast("double").alias("tokens_per_second"))


def key_union(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that some table has."""
    found = tables[0].select(key)
    for table in tables[1:]:
        found = found.unionByName(table.select(key))
    return found.where(F.col(key).isNotNull()).distinct()


def key_intersection(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that every table has."""
    found = tables[0].select(key).where(F.col(key).isNotNull()).distinct()
    for table in tables[1:]:
        found = found.join(table.select(key).distinct(), key, "left_semi")
    return found


def direction_checks(rows: DataFrame, series: Sequence[str], x: str, score: str, expected: str) -> DataFrame:
    """Per series: its score at the least and the greatest x, their difference, and whether that has the expected sign."""
    ends = rows.groupBy(*series).agg(F.min_by(score, x).alias("first"), F.max_by(score, x).alias("last"), F.max(expected).alias("expected"))
    delta = F.col("last") - F.col("first")
    return ends.withColumn("delta", delta).withColumn("passed", F.coalesce(F.signum(delta) == F.signum("expected"), F.lit(False)))


def role_contrast(rows: DataFrame, scenario: str, role: str, order: str, value: str, baseline: str, target: str) -> DataFrame:
    """Per scenario: target less baseline value. A side is the first row with its role; without one, the baseline is the
    scenario's first row and the target its last."""
    of = lambda name: F.min_by(value, F.when(F.col(role) == name, F.col(order)))
    has = lambda name: F.max(F.coalesce(F.col(role) == name, F.lit(False)))
    sides = rows.groupBy(scenario).agg(
        F.when(has(baseline), of(baseline)).otherwise(F.min_by(value, order)).alias("baseline"),
        F.when(has(target), of(target)).otherwise(F.max_by(value, order)).alias("target"),
    )
    return sides.withColumn("delta", F.col("target") - F.col("baseline"))


def paired_deltas(rows: DataFrame, keys: Sequence[str], side: str, value: str, baseline, target) -> DataFrame:
    """keys, delta: target less baseline where both sides have a row."""
    of = lambda name: F.max(F.when(F.col(side) == F.lit(name), F.col(value)))
    both = rows.groupBy(*keys).agg(of(baseline).alias("_b"), of(target).alias("_t"))
    return both.where("_b is not null and _t is not null").select(*keys, (F.col("_t") - F.col("_b")).alias("delta"))


def pair_table(points: DataFrame, name: str, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, a, b, cosine for each pair a < b of named vectors of a group.

    Points are dealt in tiles, and each tile meets each other one in a join of its own, so that the pairs of one group are spread over tasks.
    """
    part = F.pmod(F.xxhash64(name), F.lit(_TILES)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(_TILES - 1)))

    def side(own: str, other: str, n: str, v: str) -> DataFrame:
        return points.select(*keys, F.col(name).alias(n), F.col(vector).alias(v), part.alias(own), every.alias(other))

    both = side("_one", "_two", "a", "_x").join(side("_two", "_one", "b", "_y"), [*keys, "_one", "_two"]).where("a < b")
    return both.select(*keys, "a", "b", cosine_or_null(F.col("_x"), F.col("_y")).alias("cosine"))


def extreme_pairs(pairs: DataFrame, count: int, opposite: bool = False) -> DataFrame:
    """The `count` pairs of the greatest cosine, or of the least; of equal ones, those of the lesser names."""
    at = F.col("cosine")
    return pairs.where(at.isNotNull()).orderBy(at.asc() if opposite else at.desc(), "a", "b").limit(count)


def extremes(points: DataFrame, score: str, name: str, count: int) -> DataFrame:
    """(end, name, score): the `count` lowest and the `count` highest, by score and then name."""
    low = points.orderBy(score, name).limit(count).select(F.lit("low").alias("end"), name, score)
    high = points.orderBy(F.desc(score), F.desc(name)).limit(count).select(F.lit("high").alias("end"), name, score)
    return low.unionByName(high)


def cluster_alignment(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: mean cosine within it, mean to the names outside, separation (the difference), size.

    pairs is (a, b, cosine), clusters (name, cluster) with a row per name.
    """
    of = lambda end: clusters.select(F.col("name").alias(end), F.col("cluster").alias(f"_{end}"))
    placed = pairs.join(of("a"), "a").join(of("b"), "b")
    sides = F.when(F.col("_a") == F.col("_b"), F.array("_a")).otherwise(F.array("_a", "_b"))
    listed = placed.select(F.explode(sides).alias("cluster"), (F.col("_a") == F.col("_b")).alias("_same"), "cosine")
    means = listed.groupBy("cluster").agg(F.avg(F.when(F.col("_same"), F.col("cosine"))).alias("within"), F.avg(F.when(~F.col("_same"), F.col("cosine"))).alias("between"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return means.join(sizes, "cluster").withColumn("separation", F.col("within") - F.col("between"))


def same_cluster_scores(rows: DataFrame, predicted: str, wanted: str) -> DataFrame:
    """Precision and recall of the pairs that are put together, from the sizes of clusters: no pair is made."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = rows.groupBy(predicted, wanted).agg(F.count("*").alias("n"))
    hit = cells.agg(pairs("n").alias("hit"), F.lit(1).alias("_j"))
    for name, column in (("found", predicted), ("true", wanted)):
        total = cells.groupBy(column).agg(F.sum("n").alias("n")).agg(pairs("n").alias(name), F.lit(1).alias("_j"))
        hit = hit.join(total, "_j")  # rows of one number
    return hit.select(F.coalesce(F.try_divide("hit", "found"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "true"), F.lit(0.0)).alias("recall"))


def layer_similarity(pairs: DataFrame, layer: str) -> DataFrame:
    """(layer_a, layer_b, similarity): Pearson correlation of the layers' cosines over the pairs (a, b) that both have.

    Where a side does not vary it is 1 if the sides are equal, else 0.
    """
    side = lambda n: pairs.select("a", "b", F.col(layer).alias(f"layer_{n}"), F.col("cosine").alias(n))
    both = side("a_").withColumnRenamed("layer_a_", "layer_a").join(side("b_").withColumnRenamed("layer_b_", "layer_b"), ["a", "b"])
    flat = (F.stddev_pop("a_") < 1e-12) | (F.stddev_pop("b_") < 1e-12)
    equal = F.max(F.abs(F.col("a_") - F.col("b_"))) < 1e-12
    value = F.when(flat, F.when(equal, 1.0).otherwise(0.0)).otherwise(F.corr("a_", "b_"))
    return both.groupBy("layer_a", "layer_b").agg(value.alias("similarity"))


def adjacent_mean(matrix: DataFrame) -> DataFrame:
    """One row: the mean similarity of each layer and the next one that there is; null for a single layer."""
    layers = matrix.select(F.col("layer_a").alias("layer")).distinct()
    after = F.lead("layer").over(Window.orderBy("layer"))  # one row for each layer
    steps = layers.select(F.col("layer").alias("layer_a"), after.alias("layer_b")).where("layer_b is not null")
    return matrix.join(steps, ["layer_a", "layer_b"]).agg(F.avg("similarity").alias("similarity"))


LAYER_GROUPS = ("Early", "Early-Mid", "Mid-Late", "Late")


def layer_groups(layers: DataFrame, layer: str = "layer") -> DataFrame:
    """(layer, group, range): up to four runs of near equal length, the longer first, with their first and last layer."""
    parts = layers.select(layer).distinct()
    tile = F.ntile(len(LAYER_GROUPS)).over(Window.orderBy(layer))
    named = parts.withColumn("_t", tile).withColumn("group", F.element_at(F.array(*map(F.lit, LAYER_GROUPS)), F.col("_t")))
    of = Window.partitionBy("_t")
    text = F.concat_ws("-", F.min(layer).over(of).cast("string"), F.max(layer).over(of).cast("string"))
    return named.select(layer, "group", text.alias("range"))


def anchor_geometry(points: DataFrame, anchors: DataFrame, name: str, vector: str) -> DataFrame:
    """Per anchor group: the mean of its vectors, the number of them, and the cosine of its mean to each other group's.

    anchors is (name, group). Rows are (group, other, cosine, size); a group beside itself has cosine 1.
    """
    placed = points.join(anchors, name)
    means = mean_vectors(placed, ["group"], vector, "size")
    one = means.select("group", F.col(vector).alias("_x"), "size", F.lit(0).alias("_j"))
    other = means.select(F.col("group").alias("other"), F.col(vector).alias("_y"), F.lit(0).alias("_j"))
    return one.join(other, "_j").select("group", "other", cosine_or_null(F.col("_x"), F.col("_y")).alias("cosine"), "size")


def exported_direction(rows: DataFrame, vector: str, factor: float, norms: DataFrame | None = None, layer: str = "layer") -> DataFrame:
    """rows with raw_vector (the vector times factor and the residual norm of its layer, 1 without one) and vector, its
    unit vector. norms is (layer, residual_norm), a row for each layer."""
    joined = rows.join(norms, layer, "left") if norms is not None else rows.withColumn("residual_norm", F.lit(None).cast("double"))
    raw = scale(F.col(vector), F.lit(float(factor)) * F.coalesce("residual_norm", F.lit(1.0)))
    return joined.withColumn("raw_vector", raw).withColumn(vector, unit(F.col("raw_vector"))).drop("residual_norm")


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row for each key over all shards: the first in order, or the last. Keys are hashes of prompts, say, so that
    rows which share one collapse."""
    rows = shards[0]
    for shard in shards[1:]:
        rows = rows.unionByName(shard)
    pick = F.max_by if last else F.min_by
    found = pick(F.struct(*rows.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(found.alias("_r")).select("_r.*")


def if_identical(column: str, tolerance: float | None = None) -> Column:
    """An aggregate: the value that all rows of a group have, null where they differ; numbers within a tolerance."""
    least, most = F.min(column), F.max(column)
    same = (most - least <= tolerance) if tolerance is not None else least.eqNullSafe(most)
    return F.when(same & (F.count(column) == F.count("*")), least)


def capped_interleaved(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """`limit` rows, dealt over the groups in turn: at most ceil(limit / groups) of each, the first in order, then all
    first ones by group, all second ones, and so on; with their rank from 1."""
    groups = max(1, rows.select(group).distinct().count())
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= -(-limit // groups)).orderBy("rank", group).limit(limit)


def running_offsets(rows: DataFrame, keys: Sequence[str], order: str, count: str) -> DataFrame:
    """rows with begin and end: where the row's items lie among all of its group, one row after the other."""
    total = F.sum(count).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", total).withColumn("begin", F.col("end") - F.col(count))


def merged_maps(events: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Per group: one map of all events' entries, of each entry the latest."""
    listed = events.select(*keys, order, F.explode(column).alias("_k", "_v"))
    last = listed.groupBy(*keys, "_k").agg(F.max_by("_v", order).alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("_k").alias("key"), F.col("_v").alias("value"))))
    return last.groupBy(*keys).agg(F.map_from_entries(entries).alias(column))


def flattened(rows: DataFrame, structs: Mapping[str, str]) -> DataFrame:
    """rows with the fields of each struct column as columns of their own, after its prefix."""
    out = [F.col(c) for c in rows.columns if c not in structs]
    for name, prefix in structs.items():
        out += [F.col(f"{name}.{f}").alias(f"{prefix}{f}") for f in rows.schema[name].dataType.fieldNames()]
    return rows.select(*out)
