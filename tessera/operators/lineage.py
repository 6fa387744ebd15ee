"""Lookups over catalog tables of runs, steps and artifacts, and lists of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key."""
    return table.where(F.col(key) == F.lit(value))


def list_runs(runs: DataFrame, wanted: Mapping[str, object], order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` runs in order that have the wanted values; a wanted None does not filter."""
    for column, value in wanted.items():
        if value is not None:
            runs = runs.where(F.col(column) == F.lit(value))
    return runs.orderBy(*order).limit(limit)


def step_artifacts(steps: DataFrame, artifacts: DataFrame, run: str, step: str) -> DataFrame:
    """(run, step, artifact_id, manifest): the artifact that a step names, or else the least one recorded for it.

    steps has the run, the step and artifact_id, which may be null; artifacts has artifact_id, the run, the step and
    manifest. A step with neither goes.
    """
    named = artifacts.select("artifact_id", F.col("manifest").alias("_named"))
    recorded = artifacts.groupBy(run, step).agg(F.min(F.struct("artifact_id", "manifest")).alias("_recorded"))
    found = steps.select(run, step, "artifact_id").join(named, "artifact_id", "left").join(recorded, [run, step], "left")
    both = found.select(run, step, F.coalesce(F.when(F.col("_named").isNotNull(), F.struct("artifact_id", F.col("_named").alias("manifest"))), "_recorded").alias("_a"))
    return both.where("_a is not null").select(run, step, "_a.artifact_id", "_a.manifest")


def latest_reusable(steps: DataFrame, name: str, semantic: str, finished: str, key: str, status: str = "completed") -> DataFrame:
    """Per (name, semantic hash): the finished step to reuse, the last by time, steps without a time last of all."""
    best = F.max_by(F.struct(*steps.columns), F.struct(F.col(finished).isNotNull().alias("has"), F.col(finished).alias("at"), F.col(key).alias("k")))
    return steps.where(F.col("status") == status).groupBy(name, semantic).agg(best.alias("_s")).select("_s.*")


def run_artifacts(steps: DataFrame, artifacts: DataFrame, run: str, step: str, order: str) -> DataFrame:
    """Per run and key: its newest artifact; the key is that of the step which made it, or the artifact's own name."""
    keyed = artifacts.join(steps.select("artifact_id", F.col(step).alias("_step")).dropDuplicates(["artifact_id"]), "artifact_id", "left")
    keyed = keyed.withColumn("key", F.coalesce("_step", "name"))
    newest = F.max_by("artifact_id", F.struct(F.col(order).alias("o"), F.col("artifact_id").alias("a")))
    return keyed.groupBy(run, "key").agg(newest.alias("artifact_id"))


def run_detail(records: DataFrame, declared: DataFrame, run: str, step: str, order: str) -> DataFrame:
    """(run, step, status, place): recorded steps in their order, then declared ones without a record, as pending."""
    rows = records.select(run, step, "status", F.lit(0).alias("_late"), F.col(order).alias("_at"))
    pending = declared.join(records.select(run, step), [run, step], "left_anti").select(run, step, F.lit("pending").alias("status"), F.lit(1).alias("_late"), F.col(order).alias("_at"))
    listed = rows.unionByName(pending).groupBy(run).agg(F.array_sort(F.collect_list(F.struct("_late", "_at", step, "status"))).alias("_l"))
    placed = listed.select(run, F.posexplode("_l").alias("place", "_s"))
    return placed.select(run, f"_s.{step}", "_s.status", "place")


def run_edges(steps: DataFrame, declared: DataFrame, resolved: DataFrame, run: str, step: str) -> DataFrame:
    """(run, source, target, kind): declared dependencies (depends_on, an array) and resolved inputs (source), of which
    those that a step also declares are "declared" only; edges from steps that the run lacks go."""
    wanted = declared.select(run, F.col(step).alias("target"), F.explode("depends_on").alias("source"), F.lit(0).alias("_k"))
    found = resolved.select(run, F.col(step).alias("target"), "source", F.lit(1).alias("_k"))
    edges = wanted.unionByName(found).groupBy(run, "source", "target").agg(F.min("_k").alias("_k"))
    known = steps.select(run, F.col(step).alias("source")).distinct()
    return edges.join(known, [run, "source"], "left_semi").select(run, "source", "target", F.when(F.col("_k") == 0, "declared").otherwise("resolved").alias("kind"))


def compose_runs(light: DataFrame, counts: DataFrame, reports: DataFrame, local: DataFrame, run: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Light rows of runs, then those that only the local table has, with counts of steps and whether there is a report;
    in order, with the limit applied again after the merge."""
    extra = local.join(light.select(run), run, "left_anti")
    first = light.withColumn("origin", F.lit("shared")).unionByName(extra.withColumn("origin", F.lit("local"))).orderBy(*order).limit(limit)
    has = reports.select(run).distinct().withColumn("has_report", F.lit(True))
    return first.join(counts, run, "left").join(has, run, "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def keep_first(tables: Sequence[DataFrame], key: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """The union of the tables with one row for each key, that of the first table which has it; in order."""
    rows = None
    for i, table in enumerate(tables):
        part = table.withColumn("_rank", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "_rank"]
    found = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "_rank").alias("_r")).select("_r.*")
    return found if limit is None else found.orderBy(*order).limit(limit)


def preview(rows: DataFrame, order: Sequence[str], count: int, width: int) -> DataFrame:
    """The first rows, texts cut to `width` characters."""
    cut = [F.substring(c, 1, width).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.orderBy(*order).limit(count).select(*cut)


def label_summary(rows: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The distribution of a label: for numbers one row (least, greatest, mean, population std, distinct), else the `top`
    values with counts and fractions."""
    from tessera.operators.catalog import distribution, numeric_summary

    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return numeric_summary(rows, column) if dict(rows.dtypes)[column] in numbers else distribution(rows, column, top)
