"""Catalog tables of runs, steps and artifacts, and views of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """table with the rows of changes in place of those of the same keys; of changes of one key, the last in order."""
    if order is not None:
        latest = F.max_by(F.struct(*changes.columns), order)
        changes = changes.groupBy(*keys).agg(latest.alias("_r")).select("_r.*")
    return table.join(changes.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(changes.select(table.columns))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row of each group with the greatest order, nulls being least."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")).select("_r.*")


def status_counts(steps: DataFrame, run: str, status: str, names: Sequence[str]) -> DataFrame:
    """Per run: rows of each status named, and of all others."""
    parts = [F.count_if(F.col(status) == n).alias(f"n_{n}") for n in names]
    return steps.groupBy(run).agg(*parts, F.count_if(~F.coalesce(F.col(status).isin(*names), F.lit(False))).alias("n_other"))


def light_list(runs: DataFrame, steps: DataFrame, run: str, order: Sequence[Column], limit: int, wanted: Column) -> DataFrame:
    """The first `limit` runs in order, with whether some step of theirs is wanted: the limit comes before the join."""
    first = runs.orderBy(*order).limit(limit)
    flagged = steps.where(wanted).select(run).distinct().withColumn("has_wanted", F.lit(True))
    return first.join(flagged, run, "left").withColumn("has_wanted", F.coalesce("has_wanted", F.lit(False)))


def distribution(rows: DataFrame, column: str, top: int = 20, width: int = 40) -> DataFrame:
    """value (text of at most `width` characters), count and fraction of the `top` most frequent values."""
    text = F.when(F.col(column).isNull(), "null").otherwise(F.col(column).cast("string"))
    counts = rows.groupBy(text.alias("value")).agg(F.count("*").alias("count"))
    n = rows.count()
    listed = counts.orderBy(F.desc("count"), "value").limit(top)
    return listed.select(F.substring("value", 1, width).alias("value"), "count", (F.col("count") / F.lit(n)).alias("fraction"))


def numeric_summary(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean, population std and distinct values."""
    c = F.col(column)
    return rows.groupBy(*keys).agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count_distinct(c).alias("distinct"))


def carry_forward(events: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """events with the last value of the column that is not null, up to each event."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(column, F.last(column, ignorenulls=True).over(window))


def remaining(examples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Examples without a finished row: what a resumed job has to do."""
    return examples.join(done.select(key).distinct(), key, "left_anti")
