"""Projection scores on coordinates, their summaries and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import condition, cosine, dot, doubles
from tessera.sources.examples import range_part

#: Tiles of coordinates that are too many to be broadcast.
_TILES = 64
#: Ranges in which scores are counted, at least.
_RANGES = 256

SUMMARIES = ("mean", "min", "max", "std", "trend", "first_last_delta")


def scores(rows: DataFrame, coordinates: DataFrame, metric: str = "dot", on: Sequence[str] = ()) -> DataFrame:
    """A row for each of rows and each coordinate (coordinate, vector, and the columns of `on`), with score.

    The coordinates are a table of directions: broadcast if they are fewer than 10,000. More are joined on the columns
    of `on` if there are some; else they are dealt in tiles, and each row is joined with every tile.
    """
    value = {"dot": dot, "cosine": cosine}[metric](doubles("values"), doubles("vector"))
    few = coordinates.limit(10_001).count() <= 10_000
    small = F.broadcast(coordinates) if few else coordinates
    if on:
        joined = rows.join(small, list(on))
    elif few:
        joined = rows.join(small, F.size("values") == F.size("vector"))
    else:
        tiles = rows.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_TILES - 1).cast("long"))))
        joined = tiles.join(coordinates.withColumn("_tile", F.pmod(F.xxhash64("vector"), F.lit(_TILES))), "_tile").where(F.size("values") == F.size("vector")).drop("_tile")
    return joined.withColumn("score", value).drop("vector", "values")


def summarize(rows: DataFrame, keys: Sequence[str], order: str, score: str = "score", names: Sequence[str] = SUMMARIES) -> DataFrame:
    """Per group: mean, min, max, population std, slope over `order` (0 if undefined), last less first score."""
    x = F.col(score)
    built = {
        "mean": F.avg(x),
        "min": F.min(x),
        "max": F.max(x),
        "std": F.stddev_pop(x),
        "trend": F.coalesce(F.regr_slope(x, F.col(order).cast("double")), F.lit(0.0)),
        "first_last_delta": F.max_by(x, order) - F.min_by(x, order),
    }
    return rows.groupBy(*keys).agg(*[built[n].alias(n) for n in names if n in built])


def quantile_bands(rows: DataFrame, keys: Sequence[str], score: str, bands: int) -> DataFrame:
    """Per group: bands - 1 linearly interpolated thresholds, min, max and count. Null scores are left out.

    The rows of each range of scores are counted; only ranges that hold a rank on either side of a threshold are sorted.
    """
    keys, rows = list(keys), rows.where(F.col(score).isNotNull()).select(*keys, score)
    parts = max(_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_part", range_part(rows, [*keys, score], parts))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_size"), F.min(score).alias("_min"), F.max(score).alias("_max"))
    group = Window.partitionBy(*keys)
    placed = sizes.select(
        *keys, "_part", "_size", F.min("_min").over(group).alias("min"), F.max("_max").over(group).alias("max"), F.sum("_size").over(group).alias("count"),
        (F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_start"),
    )
    spots = F.array(*[F.lit(float(i)) * (F.col("count") - 1) / bands for i in range(1, bands)])
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s)))))
    here = F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")))
    wanted = placed.withColumn("_ranks", here).where(F.size("_ranks") > 0)
    held = dealt.join(wanted.select(*keys, "_part", "_start", "_ranks", "min", "max", "count"), [*keys, "_part"])
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(score)) - 1
    listed = held.withColumn("_rank", rank).where(F.array_contains("_ranks", F.col("_rank")))
    whole = listed.groupBy(*keys, "min", "max", "count").agg(F.map_from_entries(F.collect_list(F.struct("_rank", score))).alias("_at"))
    at = lambda s: F.element_at("_at", s.cast("bigint"))
    cuts = F.transform(spots, lambda s: at(F.floor(s)) + (s - F.floor(s)) * (at(F.ceil(s)) - at(F.floor(s))))
    return whole.select(*keys, cuts.alias("thresholds"), "min", "max", "count")


def assign_band(rows: DataFrame, thresholds: Column, score: str) -> DataFrame:
    """rows with band: the first, from 0, whose threshold the score does not exceed."""
    return rows.withColumn("band", F.size(F.filter(thresholds, lambda t: F.col(score) > t)))


def gap_by_layer(rows: DataFrame, positive: Column | str, negative: Column | str, score: str = "score") -> DataFrame:
    """layer, gap (mean of one side less that of the other), rank by absolute gap, the lower layer first of equal ones."""
    gaps = rows.groupBy("layer").agg((F.avg(F.when(condition(positive), F.col(score))) - F.avg(F.when(condition(negative), F.col(score)))).alias("gap"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.bround(F.abs("gap"), 9)), "layer"))
    return gaps.where("gap is not null").withColumn("rank", rank)  # one row for each layer
