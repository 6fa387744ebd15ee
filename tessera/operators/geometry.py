"""Geometry of named vectors: neutral projector, deterministic k-means, oriented components, layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles, mean_vectors, minus, norm
from tessera.operators.readouts import residual_rows
from tessera.operators.represent import moments


def _lit(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def neutral_components(rows: DataFrame, threshold: float) -> np.ndarray:
    """The leading principal components (rows) of neutral vectors that together explain `threshold` of their variance;
    none for fewer than two vectors."""
    n, mean, cov = moments(rows)
    if n < 2:
        return np.zeros((0, len(mean)))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    most = max(1, min(n, len(mean)))
    return vectors[: max(1, min(int(np.searchsorted(share, threshold, side="left")) + 1, most))]


def without_neutral(rows: DataFrame, components: np.ndarray) -> DataFrame:
    """rows with the part of their values along the components taken away."""
    return residual_rows(rows, components) if len(components) else rows


def kmeans(points: DataFrame, name: str, vector: str, k: int, iterations: int = 80) -> DataFrame:
    """(name, cluster): k-means from the vector of the greatest norm and then, one by one, the vector farthest from those
    chosen; of equal ones the first by name. With k points or fewer each is a cluster of its own, by name.

    Centres, k x d numbers, are held by the driver; every round is one aggregation over the points.
    """
    points = points.select(name, doubles(vector).alias("_v"))
    few = points.select(name).orderBy(name).limit(k + 1).collect()
    if len(few) <= k:
        return points.select(name, (F.array_position(F.array(*[F.lit(r[0]) for r in few]), F.col(name)) - 1).cast("int").alias("cluster"))
    distance = lambda c: norm(minus(F.col("_v"), _lit(c)))
    pick = lambda measure: points.select(name, "_v", measure.alias("_m")).orderBy(F.desc("_m"), name).first()["_v"]
    centers = [pick(norm(F.col("_v")))]
    while len(centers) < k:
        centers.append(pick(F.array_min(F.array(*map(distance, centers)))))
    nearest = lambda: (lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))(F.array(*map(distance, centers)))
    seen = None
    for _ in range(iterations):
        labelled = points.withColumn("cluster", nearest())
        means = mean_vectors(labelled, ["cluster"], "_v").collect()
        state = labelled.agg(F.sum(F.xxhash64(name, "cluster").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            break
        seen = state
        for r in means:
            centers[r["cluster"]] = r["_v"]
    return points.select(name, nearest().alias("cluster"))


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves of the average-linkage tree of a distance matrix, from left to right.

    The nearest two clusters are merged, of equal distances those with the lesser smallest members. The left branch of a merge is the one that was
    made first, points before merges and lesser points first. Each cluster keeps its nearest one, so a merge costs a row.
    """
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, label, leaves = np.ones(n), np.arange(n), [[i] for i in range(n)]
    alive, nearest = np.ones(n, bool), d.argmin(axis=1) if n else np.zeros(0, int)  # a cluster is named by its smallest member
    for step in range(n - 1):
        names = np.flatnonzero(alive)
        a = names[np.argmin(d[names, nearest[names]])]  # the first of equal ones
        b = nearest[a]
        a, b = min(a, b), max(a, b)
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        first, second = (a, b) if label[a] < label[b] else (b, a)
        leaves[a] = leaves[first] + leaves[second]
        size[a], label[a], alive[b] = size[a] + size[b], n + step, False
        merged[[a, b]] = np.inf
        d[a], d[:, a] = merged, merged
        d[b], d[:, b] = np.inf, np.inf
        stale = np.flatnonzero(alive & ((nearest == a) | (nearest == b)))
        nearest[stale] = d[stale].argmin(axis=1)
        nearest[a] = d[a].argmin()
        closer = np.flatnonzero(alive & ((d[:, a] < d[np.arange(n), nearest]) | ((d[:, a] == d[np.arange(n), nearest]) & (a < nearest))))
        nearest[closer[closer != a]] = a
    return leaves[0] if n else []


#: Concepts of a layer, at most: their geometry is worked out in one task.
MOST_CONCEPTS = 4096


def concept_geometry(points: DataFrame, components: int = 2, clusters: int | None = None, concepts: Sequence[str] | None = None, layers: Sequence[int] | None = None, iterations: int = 80) -> DataFrame:
    """(layer, concept, coordinates, explained, cluster, position) of named vectors (layer, concept, vector).

    coordinates are those of a PCA of the layer's vectors, explained the shares of its components, cluster is that of kmeans() (null without `clusters`) and
    position the place in the order of average linkage of 1 less the cosines. Wanted concepts and layers that are missing are an
    error; so are more than MOST_CONCEPTS of a layer, as a layer is one task. Cosines of pairs are reports.pair_table().
    """
    points = points.where("vector is not null").select("layer", F.col("concept").cast("string").alias("concept"), doubles("vector").alias("vector"))
    if layers is not None:
        points = points.where(F.col("layer").isin(list(layers)))
    if concepts is not None:
        points = points.where(F.col("concept").isin(list(concepts)))
    counts = points.groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("concept").alias("distinct")).collect()
    if layers is not None and {r["layer"] for r in counts} != set(layers):
        raise ValueError(f"layers without vectors: {sorted(set(layers) - {r['layer'] for r in counts})}")
    for r in counts:
        if r["n"] > MOST_CONCEPTS or r["n"] != r["distinct"] or concepts is not None and r["n"] != len(set(concepts)):
            raise ValueError(f"layer {r['layer']} has {r['n']} vectors of {r['distinct']} concepts")
    layer = points.schema["layer"].dataType.simpleString()

    def geometry(frame):
        import pandas as pd

        frame = frame.sort_values("concept").reset_index(drop=True)
        x = np.stack(frame["vector"].to_numpy())
        lengths = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.nan_to_num((x @ x.T) / np.outer(lengths, lengths))
        order = leaf_order(np.clip(1 - cosine, 0, 2))
        k = max(1, min(components, *x.shape))
        centered = x - x.mean(axis=0)
        _, s, vt = np.linalg.svd(centered, full_matrices=False)
        vt = vt[:k] * np.where(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        share = s**2 / max(float((s**2).sum()), 1e-300)
        place = np.empty(len(x), int)
        place[order] = np.arange(len(x))
        number = _clusters(x, clusters, iterations) if clusters is not None else [None] * len(x)
        return pd.DataFrame({"layer": frame["layer"], "concept": frame["concept"], "coordinates": list(centered @ vt.T), "explained": [share[:k]] * len(x), "cluster": pd.array(number, "Int32"), "position": place})

    schema = f"layer {layer}, concept string, coordinates array<double>, explained array<double>, cluster int, position int"
    return points.groupBy("layer").applyInPandas(geometry, schema)


def _clusters(x: np.ndarray, k: int, iterations: int) -> list[int]:
    """kmeans() of rows in the order of their names."""
    if len(x) <= k:
        return list(range(len(x)))
    centers = [x[np.linalg.norm(x, axis=1).argmax()]]
    while len(centers) < k:
        centers.append(x[np.min([np.linalg.norm(x - c, axis=1) for c in centers], axis=0).argmax()])
    seen = None
    for _ in range(iterations):
        label = np.argmin([np.linalg.norm(x - c, axis=1) for c in centers], axis=0)
        if seen is not None and (label == seen).all():
            break
        seen = label
        centers = [x[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centers)]
    return label.tolist()


def oriented(points: DataFrame, name: str, coordinates: str, anchors: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """points with each coordinate turned round if the first anchors of its pair have a lesser mean than the second."""
    means = [F.avg(F.when(F.col(name).isin(*side), F.get(coordinates, F.lit(i)))) for i, pair in enumerate(anchors) for side in pair]
    found = points.agg(*[F.coalesce(m, F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(means)]).first()
    signs = [-1.0 if found[2 * i] < found[2 * i + 1] else 1.0 for i in range(len(anchors))]
    turned = F.transform(F.col(coordinates), lambda x, i: x * F.coalesce(F.get(_lit(signs), i), F.lit(1.0)))
    return points.withColumn(coordinates, turned)


def layers_among(rows: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Rows of the wanted layers that there are; ValueError if there is none."""
    found = rows.where(F.col("layer").isin(*wanted))
    if found.isEmpty():
        raise ValueError(f"none of the layers {sorted(wanted)}")
    return found


def mapped_layers(writes: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    """writes with source_layer: the layer that the mapping gives for write_layer, or the same one."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return writes.withColumn("source_layer", F.coalesce(F.element_at(table, F.col("write_layer")), F.col("write_layer")))


def common_positions(one: DataFrame, other: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """keys and both scores, where both sides have the keys."""
    side = lambda df, n: df.select(*keys, F.col(score).alias(n))
    return side(one, "left").join(side(other, "right"), list(keys))


