"""Directions, deltas, centroids and subspaces of feature vectors (example_key, [layer,] values)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import condition, doubles, mean_vectors, minus, norm, unit, without_components


#: Parts in which the products of many tasks are added before they are added together.
_PARTS = 64


def _side_means(rows: DataFrame, keys: list[str], positive: Column | str, negative: Column | str) -> DataFrame:
    """keys, pos, neg (mean vectors of the two sides), n_pos, n_neg; a side without rows is null."""
    sided = rows.withColumn("_side", F.when(condition(positive), "pos").when(condition(negative), "neg")).where("_side is not null")
    means = mean_vectors(sided, [*keys, "_side"], "values")
    pick = lambda side, column: F.max_by(column, F.col("_side") == side)
    has = lambda side: F.max(F.col("_side") == side)
    grouped = means.groupBy(*keys) if keys else means.groupBy()
    return grouped.agg(
        *(F.when(has(s), pick(s, "values")).alias(s) for s in ("pos", "neg")),
        *(F.coalesce(F.when(has(s), pick(s, "count")), F.lit(0)).alias(f"n_{s}") for s in ("pos", "neg")),
    )


def direction(rows: DataFrame, positive: Column | str, negative: Column | str, keys: list[str] = ()) -> DataFrame:
    """keys, raw_vector (difference of the sides' means), vector (over its length), norm, n_pos, n_neg.

    Groups without both sides go.
    """
    means = _side_means(rows, list(keys), positive, negative).where("pos is not null and neg is not null")
    raw = means.withColumn("raw_vector", minus(F.col("pos"), F.col("neg")))
    return raw.select(*keys, "raw_vector", unit(F.col("raw_vector")).alias("vector"), norm(F.col("raw_vector")).alias("norm"), "n_pos", "n_neg")


def mixed_groups(rows: DataFrame, group: str, positive: Column | str, negative: Column | str) -> DataFrame:
    """Groups with rows of both sides, which a grouped direction must not have."""
    sides = rows.groupBy(group).agg(F.coalesce(F.max(condition(positive)), F.lit(False)).alias("p"), F.coalesce(F.max(condition(negative)), F.lit(False)).alias("n"))
    return sides.where("p and n").select(group)


def grouped_direction(rows: DataFrame, group: str, positive: Column | str, negative: Column | str) -> DataFrame:
    """The direction of group means: a group with a row of a side counts for it with the mean of all its rows."""
    sides = rows.groupBy(group).agg(F.coalesce(F.max(condition(positive)), F.lit(False)).alias("_p"), F.coalesce(F.max(condition(negative)), F.lit(False)).alias("_n"))
    means = mean_vectors(rows, [group], "values").join(sides.where("_p or _n"), group)
    return direction(means, F.col("_p"), F.col("_n"))


def pair_delta(rows: DataFrame, case: str, positive: Column | str, negative: Column | str) -> DataFrame:
    """case, values: for each case with both sides, the difference of their means."""
    means = _side_means(rows, [case], positive, negative).where("pos is not null and neg is not null")
    return means.select(case, minus(F.col("pos"), F.col("neg")).alias("values"))


def centroids(rows: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """keys, the label as text, values (mean) and count. A null label is the text "None"."""
    named = rows.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("None")))
    return mean_vectors(named, [*keys, label], "values")


def concept_space(rows: DataFrame, concept: str, min_examples: int = 1, keys: list[str] = (), neutral: dict | np.ndarray | None = None) -> DataFrame:
    """keys, concept, raw_vector (its mean less the unweighted mean of all concepts' means), vector, norm, count.

    Concepts with fewer examples go before the mean of means is taken; dropped_concepts() lists them. neutral has orthonormal components whose part is taken away from
    the raw vectors: one matrix, or one for each value of the first key; a value without one keeps its vectors. If no concept is left, there are no rows.
    """
    keys = list(keys)
    means = centroids(rows, concept, keys).where(F.col("count") >= min_examples)
    center = mean_vectors(means, keys, "values", "_n").select(*keys, F.col("values").alias("_center"))
    both = means.join(center, keys) if keys else means.withColumn("_center", F.lit(_one(center, "_center")))
    raw = minus(F.col("values"), F.col("_center"))
    if isinstance(neutral, dict):
        cases = [(F.col(keys[0]) == F.lit(k), without_components(raw, c)) for k, c in neutral.items()]
        whole = raw
        for case, left in cases:
            whole = F.when(case, left).otherwise(whole)
        raw = whole
    elif neutral is not None:
        raw = without_components(raw, neutral)
    both = both.withColumn("raw_vector", raw)
    return both.select(*keys, concept, "raw_vector", unit(F.col("raw_vector")).alias("vector"), norm(F.col("raw_vector")).alias("norm"), "count")


def dropped_concepts(rows: DataFrame, concept: str, min_examples: int, keys: list[str] = ()) -> DataFrame:
    """(keys, concept, count) of the concepts that concept_space() leaves out."""
    named = rows.where("values is not null").withColumn(concept, F.coalesce(F.col(concept).cast("string"), F.lit("None")))
    return named.groupBy(*keys, concept).agg(F.count("*").alias("count")).where(F.col("count") < min_examples)


def role_axis(rows: DataFrame, role: str, default: Column, min_examples: int = 1) -> DataFrame:
    """One row: the mean of the default rows less the mean of the other roles' means; rarer roles go."""
    base = mean_vectors(rows.where(default), [], "values").select(F.col("values").alias("d"), F.col("count").alias("n_default"))
    roles = mean_vectors(rows.where(~default), [role], "values").where(F.col("count") >= min_examples)
    mean = mean_vectors(roles, [], "values", "n_roles").select("values", "n_roles").withColumn("one", F.lit(1))
    raw = base.withColumn("one", F.lit(1)).join(mean, "one").withColumn("raw_vector", minus(F.col("d"), F.col("values")))
    return raw.select("raw_vector", unit(F.col("raw_vector")).alias("vector"), norm(F.col("raw_vector")).alias("norm"), "n_default", "n_roles")


def unit_direction(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """raw_vector becomes the vector and norm 1: an imported coordinate as a direction."""
    return rows.withColumn("raw_vector", unit(doubles(vector))).withColumn(vector, F.col("raw_vector")).withColumn("norm", F.lit(1.0))


def ablation_subspace(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """A subspace of one component, the direction's, with mean 0 and scale 1."""
    v = unit(doubles(vector))
    zero, one = F.transform(v, lambda x: F.lit(0.0)), F.transform(v, lambda x: F.lit(1.0))
    return rows.select(*[c for c in rows.columns if c != vector], F.array(v).alias("components"), zero.alias("mean"), one.alias("scale"))


def _one(df: DataFrame, column: str) -> list[float]:
    row = df.first()
    return list(row[column]) if row else []


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of the values; d x d numbers go to the driver. Rows without values go.

    Each task adds up the products of its batches, as one matrix product a batch, and hands on one row for each row of
    the matrix; these are added in two steps, a sorted run at a time, so that no task holds more than it has read.
    """
    table = second_moments(rows)
    found = table.orderBy("i").collect()
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = found[0]["n"]
    mean = np.array([r["total"] for r in found]) / n
    return n, mean, np.array([r["products"] for r in found]) / n - np.outer(mean, mean)


def second_moments(rows: DataFrame) -> DataFrame:
    """(i, n, total, products): for each element, rows, the sum, and the sums of its products with all elements."""
    schema = "i int, part int, n long, total double, products array<double>"
    names = [c.split()[0] for c in schema.split(", ")]

    def table(i: np.ndarray, part: int, n: int, total: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        whole = pa.array(np.full(len(i), part), pa.int32()), pa.array(np.full(len(i), n), pa.int64())
        listed = pa.ListArray.from_arrays(np.arange(0, products.size + 1, products.shape[1] or 1, dtype=np.int32), products.reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *whole, pa.array(total), listed], names=names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, second = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, total, second = n + len(x), total + x.sum(axis=0), second + x.T @ x
        for at in range(0, len(total) if n else 0, 256):
            yield table(np.arange(at, min(at + 256, len(total))), TaskContext.get().partitionId() % _PARTS, n, total[at : at + 256], second[at : at + 256])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i, part, n, total, row in zip(*(batch.column(k) for k in range(5))):
                i, row = i.as_py(), row.values.to_numpy()
                if held and held[0] == i:
                    held = (i, held[1] + n.as_py(), held[2] + total.as_py(), held[3] + row)
                    continue
                if held:
                    yield table(np.array(held[:1]), 0, held[1], np.array([held[2]]), held[3][None])
                held = (i, n.as_py(), total.as_py(), row)
        if held:
            yield table(np.array(held[:1]), 0, held[1], np.array([held[2]]), held[3][None])

    found = rows.select(doubles("values").alias("v")).where("v is not null").mapInArrow(products, schema)
    for keys in (["i", "part"], ["i"]):
        found = found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, schema)
    return found.select("i", "n", "total", "products")


def subspace(rows: DataFrame, components: int, standardize: bool = True) -> dict:
    """mean, scale, safe_scale, components (rows, the largest loading positive) and explained variance of a PCA.

    Scale is the population standard deviation, 1 where it is 0 (safe_scale) or without standardize.
    """
    n, mean, cov = moments(rows)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    safe = np.where(scale > 1e-12, scale, 1.0) if standardize else np.ones_like(scale)
    values, vectors = np.linalg.eigh(cov / np.outer(safe, safe))
    k = max(1, min(components, n, len(mean)))
    vectors = vectors[:, ::-1][:, :k].T
    vectors = vectors * np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])[:, None]
    values = np.clip(values[::-1], 0, None)
    return {"mean": mean, "scale": scale, "safe_scale": safe, "components": vectors, "explained": values[:k] / max(values.sum(), 1e-300)}


def range_subspace(rows: DataFrame, components: int, standardize: bool = True, extra: int = 16, tol: float = 1e-7, passes: int = 40, seed: int = 5) -> dict:
    """subspace() by a randomized range finder: no task and no collected table is wider than components + extra.

    A pass multiplies the values' covariance with an orthonormal basis of that width, and the result is the next basis; the eigenvalues
    within it are those of the leading components once they no longer change, which for a basis as wide as the values is at once. total is the variance
    that explained is a share of. d x (components + extra) numbers go to the driver in each pass.
    """
    from tessera.operators.solver import hold, summed

    rows = rows.where("values is not null").withColumn("_in", F.lit(0))
    first = rows.select(doubles("values").alias("v")).first()
    if first is None:
        return {"mean": np.zeros(0), "scale": np.zeros(0), "safe_scale": np.zeros(0), "components": np.zeros((0, 0)), "explained": np.zeros(0), "total": 0.0}
    center, d = np.array(first["v"]), len(first["v"])
    shared = rows.sparkSession.sparkContext.broadcast(center)

    def read(batch: pa.RecordBatch, center: np.ndarray) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - center

    def sizes(batch: pa.RecordBatch, held: dict) -> None:
        x = read(batch, shared.value)
        hold(held, (0, 0), np.array([float(len(x))]))
        hold(held, (0, 1), x.sum(0))
        hold(held, (0, 2), (x * x).sum(0))

    sums = summed(rows, sizes)
    n = int(sums[0, 0][0])
    mean = sums[0, 1] / n
    scale = np.sqrt(np.clip(sums[0, 2] / n - mean * mean, 0, None))
    safe = np.where(scale > 1e-12, scale, 1.0) if standardize else np.ones_like(scale)
    total = float(((scale / safe) ** 2).sum())
    k = max(1, min(components, n, d))
    width = min(d, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    before = None
    for _ in range(passes):
        here = rows.sparkSession.sparkContext.broadcast((center + mean, basis / safe[:, None]))

        def products(batch: pa.RecordBatch, held: dict, here=here) -> None:
            middle, b = here.value
            x = read(batch, middle)
            found = x.T @ (x @ b)
            for at in range(0, len(found), 256):
                hold(held, (0, at // 256), found[at : at + 256].ravel())

        sums = summed(rows, products)
        image = np.concatenate([sums[0, i] for i in range(len(sums))]).reshape(d, width) / n / safe[:, None]
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:k], basis @ turn[:, ::-1][:, :k]
        if width == d or before is not None and np.abs(values - before).max() <= tol * max(total, 1e-300):
            break
        before, basis = values, np.linalg.qr(image)[0]
    vectors = vectors.T
    vectors = vectors * np.where(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return {"mean": center + mean, "scale": scale, "safe_scale": safe, "components": vectors, "explained": np.clip(values, 0, None) / max(total, 1e-300), "total": total}


def group_coordinates(rows: DataFrame, group: str, space: dict) -> DataFrame:
    """(group, count, coordinates): the centroid of each group's values in a subspace, null groups left out."""
    means = mean_vectors(rows.where(F.col(group).isNotNull() & F.col("values").isNotNull()), [group], "values")
    return project_rows(means, space).select(group, "count", "coordinates")


def project_rows(rows: DataFrame, space: dict) -> DataFrame:
    """rows with coordinates: the standardized values along each component."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centered = F.zip_with(F.zip_with(doubles("values"), lit(space["mean"]), lambda x, m: x - m), lit(space["safe_scale"]), lambda x, s: x / s)
    along = [F.aggregate(F.zip_with(centered, lit(c), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) for c in space["components"]]
    return rows.withColumn("coordinates", F.array(*along))


def rms_normalize(vector: Column, eps: float = 1e-8) -> Column:
    """The vector over the root of its mean square, which is at least eps."""
    square = F.aggregate(F.transform(vector, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    rms = F.greatest(F.sqrt(square / F.size(vector)), F.lit(eps))
    return F.transform(vector, lambda x: x / rms)


def lda(rows: DataFrame, label: str, components: int, ridge: float = 1e-6) -> np.ndarray:
    """Discriminant components (rows) from class means and the pooled covariance, at most one less than the classes."""
    n, mean, cov = moments(rows)
    groups = centroids(rows, label).collect()
    between = sum(g["count"] * np.outer(np.array(g["values"]) - mean, np.array(g["values"]) - mean) for g in groups) / n
    within = cov - between + ridge * np.eye(len(mean))
    root = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(root @ between @ root.T)
    found = (vectors[:, ::-1][:, : max(1, min(components, len(groups) - 1))].T) @ root
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    return found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
