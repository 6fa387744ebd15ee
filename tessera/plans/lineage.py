"""Queries on catalog tables: orders in the role of runs, line items of steps, events of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import rounded
from tessera.operators import catalog, lineage
from tessera.plans.registry import query, table
from tessera.streaming import progress


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey = 7")
def cat_load_run(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return lineage.load(rows, "l_orderkey", 7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def cat_list_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders")
    found = lineage.list_runs(runs, {"o_orderstatus": "F", "o_custkey": None}, [F.desc("o_orderdate"), F.desc("o_orderkey")], 25)
    return found.select("o_orderkey", "o_custkey")


def _steps(spark, sf_dir):
    """A step for each user and kind of event; those of even users name their latest event as their artifact."""
    steps = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("artifact_id"))
    return steps.withColumn("artifact_id", F.when(F.col("user_id") % 2 == 0, F.col("artifact_id")))


_STEPS = "s AS (SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN max(event_id) END AS artifact_id FROM events GROUP BY user_id, event_type)"


@query(f"""
WITH {_STEPS}, r AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT user_id, event_type, coalesce(s.artifact_id, r.event_id) AS artifact_id, coalesce(e.props, f.props) AS manifest
FROM s JOIN r USING (user_id, event_type) LEFT JOIN events e ON e.event_id = s.artifact_id LEFT JOIN events f ON f.event_id = r.event_id
""")
def cat_step_artifact(spark, sf_dir):
    artifacts = table(spark, sf_dir, "events").select(F.col("event_id").alias("artifact_id"), "user_id", "event_type", F.col("props").alias("manifest"))
    return lineage.step_artifacts(_steps(spark, sf_dir), artifacts, "user_id", "event_type")


@query("""
WITH s AS (SELECT user_id % 10 AS name, event_type AS semantic, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS finished FROM events WHERE event_id % 5 <> 0)
SELECT name, semantic, event_id FROM s QUALIFY row_number() OVER (PARTITION BY name, semantic ORDER BY finished DESC NULLS LAST, event_id DESC) = 1
""")
def cat_reusable_step(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("name"), F.col("event_type").alias("semantic"), "event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("finished"),
        F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed").alias("status"),
    )
    return lineage.latest_reusable(steps, "name", "semantic", "finished", "event_id").select("name", "semantic", "event_id")


@query(f"""
WITH {_STEPS}, k AS (SELECT e.user_id, coalesce(s.event_type, 'own_' || e.event_type) AS key, e.event_id, e.ts FROM events e LEFT JOIN s ON s.artifact_id = e.event_id)
SELECT user_id, key, event_id AS artifact_id FROM k QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) = 1
""")
def cat_run_artifacts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    artifacts = events.select(F.col("event_id").alias("artifact_id"), "user_id", "ts", F.concat(F.lit("own_"), "event_type").alias("name"))
    steps = _steps(spark, sf_dir).where("artifact_id is not null")
    return lineage.run_artifacts(steps, artifacts, "user_id", "event_type", "ts")


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL), r AS (SELECT DISTINCT l_orderkey, l_linenumber, 'done' AS status FROM lineitem WHERE l_quantity > 20),
u AS (SELECT l_orderkey, l_linenumber, status, 0 AS late FROM r UNION ALL SELECT l_orderkey, l_linenumber, 'pending', 1 FROM d ANTI JOIN r USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, status, (row_number() OVER (PARTITION BY l_orderkey ORDER BY late, l_linenumber) - 1)::INT AS place FROM u
""")
def cat_run_detail(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_linenumber").alias("n"))
    records = lines.where("l_quantity > 20").select("l_orderkey", "l_linenumber", "n", F.lit("done").alias("status")).distinct()
    return lineage.run_detail(records, lines.select("l_orderkey", "l_linenumber", "n").distinct(), "l_orderkey", "l_linenumber", "n")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
d AS (SELECT k, n AS target, n - 1 AS source FROM s UNION ALL SELECT k, n, n - 9 FROM s), r AS (SELECT k, n AS target, n - 2 AS source FROM s UNION ALL SELECT k, n, n - 1 FROM s WHERE n % 2 = 0),
e AS (SELECT k, source, target, min(kind) AS kind FROM (SELECT *, 'declared' AS kind FROM d UNION ALL SELECT *, 'resolved' FROM r) GROUP BY ALL)
SELECT k, source, target, kind FROM e SEMI JOIN s ON s.k = e.k AND s.n = e.source
""")
def cat_run_edges(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    declared = steps.withColumn("depends_on", F.array(F.col("n") - 1, F.col("n") - 9))
    resolved = steps.withColumn("source", F.col("n") - 2).unionByName(steps.where("n % 2 = 0").withColumn("source", F.col("n") - 1))
    return lineage.run_edges(steps, declared, resolved, "k", "n")


@query("""
WITH l AS (SELECT o_orderkey, o_orderdate, 'shared' AS origin FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30),
x AS (SELECT o_orderkey, o_orderdate, 'local' AS origin FROM (SELECT * FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)),
f AS (SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM x) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30),
c AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_steps FROM lineitem GROUP BY 1)
SELECT o_orderkey, origin, n_steps, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_report FROM f LEFT JOIN c USING (o_orderkey)
""")
def cat_compose_runs(spark, sf_dir):
    """Runs that the shared catalog has (even keys) and those of the local one; both are lists of the newest."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    light, local = (orders.where(f"o_orderkey % {n} = 0").orderBy(*order).limit(30) for n in (2, 3))
    counts = lines.groupBy("o_orderkey").agg(F.count("*").alias("n_steps"))
    found = lineage.compose_runs(light, counts, lines.where("l_quantity > 45"), local, "o_orderkey", order, 30)
    return found.select("o_orderkey", "origin", "n_steps", "has_report")


@query("""
SELECT o_custkey AS k, 'orders' AS origin FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1
UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""")
def cat_keep_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("origin")).where("k is not null")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    return lineage.keep_first([orders, customers], "k", [F.col("k")])


@query("SELECT doc_id, substr(text, 1, 40) AS text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 12")
def view_preview(spark, sf_dir):
    return lineage.preview(table(spark, sf_dir, "documents"), ["doc_id"], 12, 40)


@query("""
SELECT count(n_chars) AS count, min(n_chars) AS min, max(n_chars) AS max, round_even(avg(n_chars), 4) + 0 AS mean, round_even(stddev_pop(n_chars), 4) + 0 AS std, count(DISTINCT n_chars) AS distinct FROM documents
""")
def view_label_numbers(spark, sf_dir):
    found = lineage.label_summary(table(spark, sf_dir, "documents"), "n_chars")
    return found.withColumn("mean", rounded(F.col("mean"))).withColumn("std", rounded(F.col("std")))


@query("""
WITH c AS (SELECT lang AS value, count(*) AS count FROM documents GROUP BY lang) SELECT value, count, round_even(count / sum(count) OVER (), 6) AS fraction FROM c
""")
def view_label_texts(spark, sf_dir):
    return lineage.label_summary(table(spark, sf_dir, "documents"), "lang").withColumn("fraction", F.bround("fraction", 6))


@query("SELECT event_id, user_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def cat_batch_load(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    wanted = events.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id")
    return events.join(wanted, "event_id", "left_semi")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def cat_staged_upsert(spark, sf_dir):
    """Staged changes, several for one key: the last stage wins."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.where("o_orderkey % 10 = 0")
    stages = changed.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("stage")).unionByName(changed.select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.lit(2).alias("stage")))
    return catalog.upsert(orders.withColumn("stage", F.lit(0)), stages, ["o_orderkey"], F.col("stage")).drop("stage")


#: Events as progress of 20 runs, with a step for each type of event.
_PROGRESS = """
p AS (SELECT 'r' || (user_id % 20) AS run_id, event_type AS step_name, length(event_type)::INT AS step_index, CASE event_id % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'DONE' ELSE 'failed' END AS status,
  's' || (event_id % 5) AS stage, event_id AS sequence, event_id::VARCHAR AS event_id, CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 7) END AS runtime_kind,
  CASE WHEN event_id % 2 = 0 THEN value END AS v, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END AS n FROM events)
"""


def _progress(spark, sf_dir):
    e, event = table(spark, sf_dir, "events"), F.col("event_id")
    number = lambda c, when: F.when(when, F.create_map(F.lit(c[0]), c[1].cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.col("event_type").alias("step_name"), F.length("event_type").alias("step_index"),
        F.element_at(F.array(*map(F.lit, ("Running", "DONE", "failed"))), (event % 3 + 1).cast("int")).alias("status"), F.concat(F.lit("s"), (event % 5).cast("string")).alias("stage"),
        event.cast("long").alias("sequence"), event.cast("string").alias("event_id"), F.when(event % 4 == 0, F.concat(F.lit("k"), (event % 7).cast("string"))).alias("runtime_kind"),
        F.lit(None).cast("string").alias("runtime_app_id"), F.map_concat(number(("v", F.col("value")), event % 2 == 0), number(("n", event), event % 3 == 0)).alias("metrics"),
    )


@query(f"""
WITH {_PROGRESS}
SELECT run_id, step_name, max(sequence) AS sequence, arg_max(status, sequence) AS status, arg_max(stage, sequence) AS stage, arg_max(runtime_kind, sequence) FILTER (runtime_kind IS NOT NULL) AS runtime_kind,
       round_even(arg_max(v, sequence) FILTER (v IS NOT NULL), 4) + 0 AS v, arg_max(n, sequence) FILTER (n IS NOT NULL) AS n FROM p GROUP BY run_id, step_name
""")
def cat_progress_snapshots(spark, sf_dir):
    found = progress.snapshots(_progress(spark, sf_dir))
    return found.select("run_id", "step_name", "sequence", "status", "stage", "runtime_kind", rounded(F.try_element_at("metrics", F.lit("v"))).alias("v"), F.try_element_at("metrics", F.lit("n")).alias("n"))


@query(f"""
WITH {_PROGRESS}, l AS (SELECT run_id, step_name, lower(arg_max(status, sequence)) AS status, max(step_index) AS i FROM p WHERE step_name IS NOT NULL GROUP BY ALL),
t AS (SELECT run_id, greatest(max(i) + 1, count(*))::BIGINT AS step_total FROM l GROUP BY run_id)
SELECT run_id, status, count(*) AS steps, step_total FROM l JOIN t USING (run_id) GROUP BY ALL
""")
def cat_run_summaries(spark, sf_dir):
    return progress.run_summaries(_progress(spark, sf_dir)).select("run_id", F.explode("step_counts").alias("status", "steps"), "step_total")
