"""Scores of every token on every coordinate, as products of blocks of rows and tiles of coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import doubles

#: Coordinates up to so many numbers are broadcast; more are dealt in tiles, which meet blocks of rows by a join.
BROADCAST_NUMBERS = 4_000_000
#: Rows of a block and coordinates of a tile in that join.
BLOCK, TILE = 512, 256


def _matrix(column: pa.Array) -> np.ndarray:
    """List values of one width, as an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any():
        raise ValueError("vectors of different widths")
    return flat.reshape(len(column), -1)


def _product(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores (rows, coordinates)."""
    if x.shape[1] != c.shape[1]:
        raise ValueError(f"values of {x.shape[1]} numbers on coordinates of {c.shape[1]}")
    found = x @ c.T
    if metric == "cosine":
        lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)
        found = np.divide(found, lengths, out=np.zeros_like(found), where=lengths > 0)
    return found


def missing_coordinates(coordinates: DataFrame, names: Sequence[str], layers: Sequence[int]) -> list[tuple[int, str]]:
    """(layer, coordinate) of those that are wanted and not there."""
    spark = coordinates.sparkSession
    kind = coordinates.schema["layer"].dataType.simpleString()
    wanted = spark.createDataFrame([(layer, name) for layer in layers for name in names], f"layer {kind}, coordinate string")
    have = coordinates.where("vector is not null").select("layer", F.col("coordinate").cast("string").alias("coordinate"))
    return sorted(map(tuple, wanted.join(have, ["layer", "coordinate"], "left_anti").collect()))


def dense_scores(rows: DataFrame, coordinates: DataFrame, metric: str = "cosine", only: str | None = None, keep: Sequence[str] = ("example_key", "token_pos")) -> DataFrame:
    """(keep, layer, coordinate, score) for each row (layer, values, and the columns of keep) and each coordinate (layer, coordinate, vector) of its layer.

    metric is dot or cosine, which is 0 where a vector is zero. With `only`, a column of rows that names a coordinate, a row is scored on
    that one alone. Rows without values, and layers without coordinates, give no scores.

    Few coordinates are broadcast, and every batch is multiplied by those of its layers. Beyond BROADCAST_NUMBERS they are dealt in tiles, rows in
    blocks, and each block meets each tile of its layer in a join, so that no task holds more than one of either.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError(f"no metric {metric!r}")
    keep = list(keep)
    picked = [F.col(only).cast("string").alias("_only")] if only else []
    rows = rows.where("values is not null").select(*keep, F.col("layer"), *picked, doubles("values").alias("values"))
    points = coordinates.where("vector is not null").select(F.col("layer").cast(rows.schema["layer"].dataType).alias("layer"), F.col("coordinate").cast("string").alias("coordinate"), doubles("vector").alias("vector"))
    out = T.StructType([*(rows.schema[c] for c in [*keep, "layer"]), T.StructField("coordinate", T.StringType()), T.StructField("score", T.DoubleType())])
    numbers = points.agg(F.sum(F.size("vector"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        return _by_broadcast(rows, points, metric, bool(only), out)
    return _by_tiles(rows, points, metric, bool(only), keep, out)


def _table(batch: pa.RecordBatch, columns: int, at: np.ndarray, names: pa.Array, scores: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    kept = [batch.column(i).take(pa.array(at)) for i in range(columns)]
    return pa.RecordBatch.from_arrays([*kept, names, pa.array(scores)], names=schema.names)


def _chosen(found: np.ndarray, names: list[str], only: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates whose scores are given out: all of them, or of each row the named one."""
    if only is None:
        return np.repeat(np.arange(len(found)), len(names)), np.tile(np.arange(len(names)), len(found))
    place = {n: i for i, n in enumerate(names)}
    at = np.array([place.get(n, -1) for n in only], np.int64)
    return np.flatnonzero(at >= 0), at[at >= 0]


def _by_broadcast(rows: DataFrame, points: DataFrame, metric: str, only: bool, out: T.StructType) -> DataFrame:
    by_layer: dict = {}
    for r in points.orderBy("layer", "coordinate").collect():
        names, vectors = by_layer.setdefault(r["layer"], ([], []))
        names.append(r["coordinate"])
        vectors.append(r["vector"])
    shared = rows.sparkSession.sparkContext.broadcast({k: (n, np.array(v)) for k, (n, v) in by_layer.items()})
    columns = len(out) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layers = batch.column(columns - 1)
            for layer in layers.unique().to_pylist():
                if layer not in shared.value:
                    continue
                part = batch.filter(pc.equal(layers, layer))
                names, c = shared.value[layer]
                labels = pa.array(names)
                for start in range(0, part.num_rows, BLOCK):
                    block = part.slice(start, BLOCK)
                    found = _product(_matrix(block.column(block.num_columns - 1)), c, metric)
                    at, to = _chosen(found, names, block.column(columns).to_pylist() if only else None)
                    yield _table(block, columns, at, labels.take(pa.array(to)), found[at, to], out)

    return rows.mapInArrow(run, out)


def _by_tiles(rows: DataFrame, points: DataFrame, metric: str, only: bool, keep: list[str], out: T.StructType) -> DataFrame:
    def grouped(table: DataFrame, size: int, name: str) -> DataFrame:
        """Rows of one layer put together by `size` at most, as arrays; a task's rows stay where they are."""
        number = F.monotonically_increasing_id()
        fields = [c for c in table.columns if c != "layer"]
        parts = table.withColumn("_group", F.floor(number / size))
        return parts.groupBy("layer", "_group").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_group")

    pairs = grouped(rows, BLOCK, "_rows").join(grouped(points, TILE, "_tile"), "layer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, tile = batch.column(1)[i].values, batch.column(2)[i].values
                names = tile.field("coordinate").to_pylist()
                found = _product(_matrix(block.field("values")), _matrix(tile.field("vector")), metric)
                at, to = _chosen(found, names, block.field("_only").to_pylist() if only else None)
                layer = pa.array([batch.column(0)[i].as_py()] * len(at), batch.schema.field(0).type)
                kept = [block.field(c).take(pa.array(at)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, layer, tile.field("coordinate").take(pa.array(to)), pa.array(found[at, to])], names=out.names)

    return pairs.select("layer", "_rows", "_tile").mapInArrow(run, out)


def single_token_scores(rows: DataFrame, coordinates: DataFrame, names: Sequence[str], layers: Sequence[int], metric: str = "cosine", key: str = "example_key") -> DataFrame:
    """(key, layer, coordinate, slice_count, score) of features of one token: a row (key, layer, values) for each example and layer.

    Only the named coordinates and layers are scored; one that is missing is an error. slice_count is 1.
    """
    gone = missing_coordinates(coordinates, names, layers)
    if gone:
        raise ValueError(f"coordinates that are missing: {gone[:5]}")
    chosen = coordinates.where(F.col("coordinate").isin(list(names)) & F.col("layer").isin(list(layers)))
    found = dense_scores(rows.where(F.col("layer").isin(list(layers))), chosen, metric, keep=[key])
    return found.select(key, "layer", "coordinate", F.lit(1).alias("slice_count"), "score")


def token_series(scores: DataFrame, keys: Sequence[str] = ("example_key", "layer", "coordinate"), position: str = "token_pos") -> DataFrame:
    """keys, token_positions, scores: a row for each series, in the order of positions."""
    listed = F.array_sort(F.collect_list(F.struct(position, "score")))
    parts = scores.groupBy(*keys).agg(listed.alias("_s"))
    return parts.select(*keys, F.col(f"_s.{position}").alias("token_positions"), F.col("_s.score").alias("scores"))


def side_deltas(scores: DataFrame, side: Column, baseline, target, keys: Sequence[str] = ("layer", "coordinate", "token_pos"), label: str | None = None) -> DataFrame:
    """keys, baseline_score, target_score, delta: where both sides have a score of the same token.

    label names a column whose value on the baseline's side is kept as token_label, or that on the target's where it is null. Several scores of a side count
    with their mean.
    """
    of = lambda name, value: F.avg(F.when(side == F.lit(name), F.col(value)))
    first = lambda name: F.min(F.when(side == F.lit(name), F.col(label)))
    labels = [F.coalesce(first(baseline), first(target)).alias("token_label")] if label else []
    both = scores.groupBy(*keys).agg(of(baseline, "score").alias("baseline_score"), of(target, "score").alias("target_score"), *labels)
    both = both.where("baseline_score is not null and target_score is not null")
    return both.withColumn("delta", F.col("target_score") - F.col("baseline_score"))
