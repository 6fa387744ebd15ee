"""Column functions on vectors, held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(test: Column | str) -> Column:
    """A condition given as a column or as SQL."""
    return F.expr(test) if isinstance(test, str) else test


def doubles(vector: str | Column) -> Column:
    """The vector's elements as doubles."""
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where a side is null or the lengths differ."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def without_components(a: Column, components) -> Column:
    """The vector without its part in the span of orthonormal components (rows of numbers)."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    left = a
    for c in components:  # each part is that of the vector itself, as the components are orthonormal
        left = minus(left, scale(lit(c), dot(a, lit(c))))
    return left


def softmax(a: Column) -> Column:
    """Exponentials of the differences to the greatest element, over their sum."""
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / total(powers))


def top_k(a: Column, k: int) -> Column:
    """(value, index) of the k greatest elements in descending order; of equal ones, the greater index first."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("value"), i.alias("index")))
    return F.slice(F.sort_array(pairs, asc=False), 1, k)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, count: str = "count") -> DataFrame:
    """keys, `vector` (the mean over the rows of each group) and the number of rows.

    Elements are averaged with partial aggregation on each side of the shuffle: what is shuffled is one partial sum
    for each group, element and task, and the arrays are put together from one row per element.
    """
    items = rows.select(*keys, F.posexplode(doubles(vector)).alias("_at", "_value"))
    means = items.groupBy(*keys, "_at").agg(F.avg("_value").alias("_mean"), F.count("*").alias(count))
    parts = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_mean"))).alias("_parts"), F.max(count).alias(count))
    return parts.select(*keys, F.transform("_parts", lambda p: p["_mean"]).alias(vector), count)


def rounded(column: Column, places: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.bround(column, places) + F.lit(0.0)


def cosine_or_null(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
