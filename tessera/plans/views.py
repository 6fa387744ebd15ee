"""Queries on catalog tables: events and orders in the roles of steps, runs and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import rounded
from tessera.operators import catalog, tokens
from tessera.plans.registry import query, table


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT max(o_orderkey) + 1, 'N' FROM orders
""")
def cat_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("F"))
    added = orders.agg((F.max("o_orderkey") + 1).alias("o_orderkey")).withColumn("o_orderstatus", F.lit("N"))
    return catalog.upsert(orders, changed.unionByName(added), ["o_orderkey"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def cat_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return catalog.latest(events, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def cat_distinct_on(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view,
       count(*) FILTER (event_type NOT IN ('click', 'view') OR event_type IS NULL) AS n_other FROM events GROUP BY user_id
""")
def cat_status_counts(spark, sf_dir):
    return catalog.status_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view"])


@query("""
WITH r AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40)
SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_wanted FROM r
""")
def cat_light_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    listed = catalog.light_list(orders, steps, "o_orderkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 40, F.col("l_quantity") > 45)
    return listed.select("o_orderkey", "o_custkey", "has_wanted")


@query("""
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC,
  CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, event_id DESC) = 1
""")
def cat_best_candidate(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return catalog.latest(events, ["user_id"], F.date_trunc("day", F.col("ts")), rank, F.col("event_id")).select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def cat_resume_remaining(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return catalog.remaining(events, events.where("event_type = 'view'"), "event_id").select("event_id")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events
""")
def cat_carry_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("carried", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return catalog.carry_forward(events, ["user_id"], "event_id", "carried").select("event_id", "carried")


@query("""
WITH c AS (SELECT source AS value, count(*) AS count FROM documents GROUP BY source)
SELECT value, count, round_even(count / sum(count) OVER (), 6) AS fraction FROM c ORDER BY count DESC, value LIMIT 20
""")
def view_label_dist(spark, sf_dir):
    return catalog.distribution(table(spark, sf_dir, "documents"), "source").withColumn("fraction", F.bround("fraction", 6))


@query("SELECT substr(o_clerk, 1, 40) AS value, n AS count FROM (SELECT o_custkey::VARCHAR AS o_clerk, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_clerk LIMIT 20)")
def view_top20(spark, sf_dir):
    return catalog.distribution(table(spark, sf_dir, "orders"), "o_custkey").select("value", "count")


@query("""
SELECT lang, count(n_chars) AS count, min(n_chars) AS min, max(n_chars) AS max, round_even(avg(n_chars), 4) + 0 AS mean, round_even(stddev_pop(n_chars), 4) + 0 AS std, count(DISTINCT n_chars) AS distinct
FROM documents GROUP BY lang
""")
def view_numeric_summary(spark, sf_dir):
    found = catalog.numeric_summary(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return found.withColumn("mean", rounded(F.col("mean"))).withColumn("std", rounded(F.col("std")))


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS start, l_linenumber * 10 + CASE WHEN l_quantity > 25 THEN 10 ELSE 4 END AS stop FROM lineitem),
m AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY start, stop) AS grp FROM m)
SELECT k, min(start) AS start, max(stop) AS stop FROM g GROUP BY k, grp
""")
def span_union(spark, sf_dir):
    length = F.when(F.col("l_quantity") > 25, 10).otherwise(4)
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + length).alias("stop"))
    return tokens.merge_spans(spans, ["k"])


@query("""
SELECT l_linestatus, l_returnflag, grouping(l_returnflag)::INT AS level, count(*) AS n, round_even(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)
""")
def ext_rollup(spark, sf_dir):
    rolled = table(spark, sf_dir, "lineitem").rollup("l_linestatus", "l_returnflag")
    return rolled.agg(F.grouping("l_returnflag").cast("int").alias("level"), F.count("*").alias("n"), F.bround(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round_even(sum(value), 3) AS total FROM events GROUP BY ALL")
def ext_tumbling_batch(spark, sf_dir):
    from tessera.streaming.events import hourly

    return hourly(table(spark, sf_dir, "events")).withColumn("total", F.bround("total", 3))


@query("""
WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s
""")
def ext_sessions_batch(spark, sf_dir):
    from tessera.streaming.events import sessions

    found = sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id FROM events GROUP BY ALL")
def ext_first_events_batch(spark, sf_dir):
    from tessera.streaming.events import first_events

    return first_events(table(spark, sf_dir, "events")).select("event_id", "user_id")
