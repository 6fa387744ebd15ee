"""Progress of runs and their steps: snapshots and summaries that are kept up as events arrive, in any order.

An event is (run_id, step_name, step_index, status, stage, sequence, event_id, runtime_kind, runtime_app_id, metrics); one without a step is about
the run. What counts of an event is decided by its place (sequence, event_id), not by when it arrives, so a stream whose events
are out of order or come twice ends where the batch form of the same function does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = T.StructType([T.StructField(name, kind) for name, kind in (
    ("run_id", T.StringType()), ("step_name", T.StringType()), ("step_index", T.IntegerType()), ("status", T.StringType()), ("stage", T.StringType()),
    ("sequence", T.LongType()), ("event_id", T.StringType()), ("runtime_kind", T.StringType()), ("runtime_app_id", T.StringType()),
    ("metrics", T.MapType(T.StringType(), T.DoubleType())),
)])
_LAST = ["step_index", "status", "stage"]
_CARRIED = ["runtime_kind", "runtime_app_id"]
_SNAPSHOT = "run_id string, step_name string, sequence long, step_index int, status string, stage string, runtime_kind string, runtime_app_id string, metrics map<string,double>"
_SUMMARY = "run_id string, step_counts map<string,long>, step_total long"


def _place():
    return F.struct("sequence", "event_id")


def snapshots(events: DataFrame) -> DataFrame:
    """(run_id, step_name, sequence, step_index, status, stage, runtime_kind, runtime_app_id, metrics): the state of each run and step.

    Status, stage and index are those of the last event; the runtime is that of the last one that names it, and each metric has its last value.
    On a stream, a row for each run and step that a batch touches; the one with the most `seen` events is the present one.
    """
    if events.isStreaming:
        keyed = events.withColumn("_step", F.coalesce("step_name", F.lit("")))
        return keyed.groupBy("run_id", "_step").transformWithStateInPandas(_Snapshots(), f"{_SNAPSHOT}, seen long", "Update", "None")
    keys = ["run_id", "step_name"]
    last = [F.max_by(c, _place()).alias(c) for c in _LAST]
    carried = [F.max_by(c, F.when(F.col(c).isNotNull(), _place())).alias(c) for c in _CARRIED]
    rows = events.groupBy(*keys).agg(F.max("sequence").alias("sequence"), *last, *carried)
    each = events.select(*keys, "sequence", "event_id", F.explode("metrics").alias("_k", "_v"))
    values = each.groupBy(*keys, "_k").agg(F.max_by("_v", _place()).alias("_v"))
    listed = values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("metrics"))
    listed = listed.select(F.col("run_id").alias("_r"), F.col("step_name").alias("_s"), "metrics")
    both = rows.join(listed, F.col("run_id").eqNullSafe(F.col("_r")) & F.col("step_name").eqNullSafe(F.col("_s")), "left").drop("_r", "_s")
    return both.withColumn("metrics", F.coalesce("metrics", F.create_map().cast("map<string,double>")))


def run_summaries(events: DataFrame) -> DataFrame:
    """(run_id, step_counts, step_total): how many steps of each run have which status (in lower case; none without one), and how many steps
    there are: those seen, or up to the greatest index.

    On a stream, a row for each run that a batch touches, with `seen`, the events of the run so far.
    """
    steps = events.where("step_name is not null")
    if events.isStreaming:
        return steps.groupBy("run_id").transformWithStateInPandas(_Summaries(), f"{_SUMMARY}, seen long", "Update", "None")
    last = steps.groupBy("run_id", "step_name").agg(F.lower(F.max_by("status", _place())).alias("status"), F.max("step_index").alias("index"))
    counts = last.groupBy("run_id", "status").agg(F.count("*").alias("n"), F.max("index").alias("index"))
    named = F.collect_list(F.when(F.coalesce("status", F.lit("")) != "", F.struct("status", "n")))
    total = F.greatest(F.coalesce(F.max("index") + 1, F.lit(0)).cast("long"), F.coalesce(F.sum(F.when(F.coalesce("status", F.lit("")) != "", F.col("n"))), F.lit(0)))
    return counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(named)).alias("step_counts"), total.alias("step_total"))


def _text(value) -> str | None:
    return None if value is None or value != value else str(value)


def _number(value) -> int | None:
    return None if value is None or value != value else int(value)


class _Snapshots(StatefulProcessor):
    """Of each run and step: the last event, the last of each carried field and the last value of each metric, with their places."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long, event_id string, step_index int, status string, stage string, seen long")
        self.carried = handle.getMapState("carried", "name string", "sequence long, event_id string, value string")
        self.metrics = handle.getMapState("metrics", "name string", "sequence long, event_id string, value double")

    def _put(self, state, name: str, place: tuple[int, str], value) -> None:
        if not state.containsKey((name,)) or tuple(state.getValue((name,))[:2]) <= place:
            state.updateValue((name,), (*place, value))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        run, step, seen = key[0], None, last[5] if last else 0
        for frame in rows:
            for e in frame.to_dict("records"):
                place, seen, step = (int(e["sequence"]), str(e["event_id"])), seen + 1, _text(e["step_name"])
                if last is None or (last[0], last[1]) <= place:
                    last = (*place, _number(e["step_index"]), _text(e["status"]), _text(e["stage"]), seen)
                for name in _CARRIED:
                    if _text(e[name]) is not None:
                        self._put(self.carried, name, place, str(e[name]))
                for name, value in dict(e["metrics"] or ()).items():
                    self._put(self.metrics, name, place, value)
        last = (*last[:5], seen)
        self.last.update(last)
        carried = {k[0]: v[2] for k, v in self.carried.iterator()}
        metrics = {k[0]: v[2] for k, v in self.metrics.iterator()}
        row = (run, step, last[0], *last[2:5], carried.get("runtime_kind"), carried.get("runtime_app_id"), metrics, seen)
        names = ["run_id", "step_name", "sequence", *_LAST, *_CARRIED, "metrics", "seen"]
        yield pd.DataFrame([row], columns=names).astype({"step_index": "Int32"})


class _Summaries(StatefulProcessor):
    """Of each run: each step's last status, with its place and greatest index; counts by status are kept up, not counted again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step string", "sequence long, event_id string, status string")
        self.counts = handle.getMapState("counts", "status string", "n long")
        self.total = handle.getValueState("total", "greatest long, seen long")

    def _add(self, status: str, by: int) -> None:
        n = by + (self.counts.getValue((status,))[0] if self.counts.containsKey((status,)) else 0)
        if n > 0:
            self.counts.updateValue((status,), (n,))
        else:
            self.counts.removeKey((status,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        greatest, seen = tuple(self.total.get()) if self.total.exists() else (0, 0)
        for frame in rows:
            for e in frame.to_dict("records"):
                place, step = (int(e["sequence"]), str(e["event_id"])), (str(e["step_name"]),)
                status, index, seen = (_text(e["status"]) or "").lower(), _number(e["step_index"]), seen + 1
                greatest = max(greatest, 0 if index is None else index + 1)
                before = tuple(self.steps.getValue(step)) if self.steps.containsKey(step) else None
                if before is None or before[:2] <= place:
                    if before and before[2]:
                        self._add(before[2], -1)
                    if status:
                        self._add(status, 1)
                    self.steps.updateValue(step, (*place, status))
        self.total.update((greatest, seen))
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        yield pd.DataFrame([(key[0], counts, max(greatest, sum(counts.values())), seen)], columns=["run_id", "step_counts", "step_total", "seen"])


def present(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that a stream has put out, the present one of each key."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*columns), "seen").alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").drop("seen")
