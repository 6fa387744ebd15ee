"""Reads of a database that runs in the session's own process."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import hash_shard
from tessera.sources import database as db

URL = "jdbc:derby:memory:tessera;create=true"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i * 3, f"it's {i}", hashlib.sha256(str(i).encode()).hexdigest(), f"k{i:05d}", None if i % 5 == 0 else i / 4) for i in range(1050)]
    frame = spark.createDataFrame(rows, "id long, name string, digest string, code string, score double")
    types = "name VARCHAR(100), digest VARCHAR(64), code VARCHAR(20)"
    frame.coalesce(1).write.format("jdbc").option("url", URL).option("dbtable", "items").option("createTableColumnTypes", types).mode("overwrite").save()
    return frame


@pytest.mark.parametrize("size", [1, 100, 105, 1049, 1050, 1051, 5000])
def test_pages(spark, table, size):
    if size == 1:
        table, sql, n = table.where("id < 21"), 'SELECT * FROM items WHERE "id" < 21 ;', 7
    else:
        sql, n = "SELECT * FROM items", 1050
    bounds = db.page_bounds(spark, URL, "code", size, sql=sql)
    assert len(bounds) == -(-n // size) and bounds[-1] == f"k{n - 1:05d}"
    for key in ("id", "code"):
        got = db.read_pages(spark, URL, ["name", "score", "id"], key, size, sql=sql)
        assert got.columns == ["name", "score", "id"]
        assert sorted(map(str, got.collect())) == sorted(map(str, table.select("name", "score", "id").collect()))
    parts = db.read_pages(spark, URL, ["id"], "id", size, sql=sql).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) == min(size, n)


def test_pages_of_nothing(spark, table):
    assert db.read_pages(spark, URL, ["id"], "id", 10, sql='SELECT * FROM items WHERE "id" < 0').count() == 0
    assert db.read_pages(spark, URL, ["id", "id"], "score", 100, sql='SELECT * FROM items WHERE "score" IS NULL').count() == 210
    with pytest.raises(ValueError):
        db.read_pages(spark, URL, ["id"], "id", 0, sql="SELECT * FROM items")


def test_columns_limits_and_shards(spark, table):
    source = "SELECT * FROM items"
    assert db.read_columns(spark, URL, ["id", "name", "id"], sql=source).columns == ["id", "name"]
    assert db.read_columns(spark, URL, ["id"], sql=source, limit=17).count() == 17
    shards = [db.read_columns(spark, URL, ["id"], sql=source, shard=("digest", 4, i)) for i in range(4)]
    want = {r["id"]: r["s"] for r in table.select("id", hash_shard(F.col("digest"), 4).alias("s")).collect()}
    got = {r["id"]: i for i, s in enumerate(shards) for r in s.collect()}
    assert got == want
    few = db.read_columns(spark, URL, ["id"], sql=source, shard=("digest", 4, 2), limit=9).collect()
    assert len(few) == 9 and all(want[r["id"]] == 2 for r in few)
    with pytest.raises(ValueError):
        db.read_columns(spark, URL, ["id"], sql=source, shard=("digest", 4, 4))


def test_queries():
    assert db.select_sql(["a", "b", "a"], table="x.y", where=["1 = 1"], order="a", limit=5) == 'SELECT "a", "b" FROM "x"."y" src WHERE 1 = 1 ORDER BY "a" FETCH FIRST 5 ROWS ONLY'
    assert db.literal("it's") == "'it''s'" and db.literal(None) == "NULL" and db.literal(True) == "TRUE" and db.literal(-2.5) == "-2.5"
    assert db._postgres_shard("h", 7) == "(CAST(CAST('x' || substr(\"h\", 1, 8) AS bit(32)) AS bigint) % 7 * 4 + CAST(CAST('x' || substr(\"h\", 9, 8) AS bit(32)) AS bigint)) % 7"
    for digest in ("ffffffffffffffff00", hashlib.sha256(b"x").hexdigest()):  # what the expression computes
        high, low = int(digest[:8], 16), int(digest[8:16], 16)
        assert all((high % n * (2**32 % n) + low) % n == int(digest[:16], 16) % n for n in (1, 2, 7, 1000, 2**31 - 1))
    for wrong in (lambda: db.identifier('a"b'), lambda: db.relation("a..b"), lambda: db.literal("a\x00"), lambda: db.literal(float("nan")), lambda: db.select_sql(["a"]), lambda: db.select_sql(["a"], "t", "SELECT 1"), lambda: db.select_sql(["a"], sql=" ; ")):
        with pytest.raises(ValueError):
            wrong()
