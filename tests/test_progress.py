"""Progress streams against their batch form, with events out of order, twice, and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import progress
from tessera.streaming.events import read_events


def made_events(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run, step = f"r{rng.randrange(4)}", rng.choice([None, "a", "b", "c", "d"])
        metrics = rng.choice([None, {}, {"loss": i / 8}, {"loss": float(i), "rows": 1.0 * i}, {f"m{i % 3}": 0.5}])
        rows.append((run, step, None if step is None or i % 7 == 0 else "abcd".index(step) * 2, rng.choice(["Running", "done", "FAILED", None]), f"s{i % 5}", i // 2, f"e{i:05d}", rng.choice([None, "spark"]), rng.choice([None, None, f"app{i}"]), metrics))
    rng.shuffle(rows)
    return rows + rows[: n // 5]  # events that come twice


def fold(rows):
    """The snapshot of each run and step, and the summary of each run, event by event in their order."""
    snaps, summaries = {}, {}
    for run, step, index, status, stage, seq, event, kind, app, metrics in sorted(rows, key=lambda r: (r[5], r[6])):
        old = snaps.get((run, step), (None,) * 6 + ({},))
        snaps[run, step] = (seq, index, status, stage, kind if kind is not None else old[4], app if app is not None else old[5], {**old[6], **(metrics or {})})
        if step is not None:
            statuses, greatest = summaries.setdefault(run, [{}, 0])
            statuses[step] = (status or "").lower()
            summaries[run][1] = max(greatest, 0 if index is None else index + 1)
    counted = {}
    for run, (statuses, greatest) in summaries.items():
        counts = {s: list(statuses.values()).count(s) for s in statuses.values() if s}
        counted[run] = (counts, max(greatest, sum(counts.values())))
    return snaps, counted


def found(snaps, summaries):
    return (
        {(r["run_id"], r["step_name"]): (r["sequence"], r["step_index"], r["status"], r["stage"], r["runtime_kind"], r["runtime_app_id"], r["metrics"]) for r in snaps.collect()},
        {r["run_id"]: (r["step_counts"], r["step_total"]) for r in summaries.collect()},
    )


def test_batch(spark):
    rows = made_events(300)
    table = spark.createDataFrame(rows, progress.EVENT).repartition(5)
    assert found(progress.snapshots(table), progress.run_summaries(table)) == fold(rows)
    assert progress.snapshots(table.where("false")).count() == progress.run_summaries(table.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["snapshots", "run_summaries"])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, kind):
    rows = made_events(120, 9)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
        for part in (rows[:70], rows[70:]):  # the query is started again for the second half
            spark.createDataFrame(part, progress.EVENT).coalesce(2).write.mode("append").parquet(source)
            stream = getattr(progress, kind)(read_events(spark, source, progress.EVENT))

            def put(batch, number):
                batch.write.mode("append").parquet(out)

            stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(300)
        got = spark.read.parquet(out)
        if kind == "snapshots":
            assert found(progress.present(got.withColumn("step_name", F.col("step_name")), ["run_id", "step_name"]), spark.createDataFrame([], progress._SUMMARY))[0] == fold(rows)[0]
        else:
            assert found(spark.createDataFrame([], progress._SNAPSHOT), progress.present(got, ["run_id"]))[1] == fold(rows)[1]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
