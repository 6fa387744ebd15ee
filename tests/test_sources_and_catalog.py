import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import fill_template, has_word, judge_score, name_key
from tessera.operators import catalog, readouts, select
from tessera.sources import examples as src
from tessera.streaming import events as ev


def test_examples_and_missing_columns(spark):
    data = spark.createDataFrame([(1, "p", None)], "id int, prompt string, c string")
    r = src.examples(data, "id", labels=["nope"], cases=["c"]).first()
    assert r.asDict() == {"example_key": "1", "prompt": "p", "label_nope": None, "case_c": None}
    with pytest.raises(KeyError):
        src.examples(data, "id", template="{absent}")


def test_template_null(spark):
    r = spark.range(1).select(fill_template("{a} {{b}}", {"a": F.lit(None)}).alias("t")).first()
    assert r["t"] == "None {b}"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"examples": [{"k": 1}, {"k": 2}]}))
    (tmp_path / "b.jsonl").write_text('{"k": 3}\n\n{"k": 4}\n')
    assert src.read_file(spark, str(tmp_path / "a.json")).count() == 2
    assert sorted(r["k"] for r in src.read_file(spark, str(tmp_path / "b.jsonl")).collect()) == [3, 4]
    with pytest.raises(ValueError):
        src.read_file(spark, "x.csv")
    packs = src.read_packs(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.jsonl")}, 1)
    named = src.read_packs(spark, {"b": str(tmp_path / "b.jsonl"), "a": str(tmp_path / "a.json")}, given={"a": {"side": "x"}}, limit=1)
    assert [(r["source"], r["side"], r["example_key"]) for r in named.collect()] == [("b", None, "b_000000")]
    assert {(r["source"], r["side"]) for r in src.read_packs(spark, {"b": str(tmp_path / "b.jsonl"), "a": str(tmp_path / "a.json")}, given={"a": {"side": "x"}}).collect()} == {("a", "x"), ("b", None)}
    assert sorted(r["example_key"] for r in packs.collect()) == ["a_000000", "b_000000"]


def test_table_names(spark):
    for bad in ({"table": "a; drop"}, {}, {"table": "a", "sql": "select 1"}):
        with pytest.raises(ValueError):
            src.read_table(spark, "jdbc:x", **bad)


def test_numbering(spark):
    data = spark.range(100).select((99 - F.col("id")).alias("v"))
    assert all(r["v"] == r["ord"] for r in src.number_rows(data, ["v"]).collect())


def test_explode_null_gives_no_row(spark):
    data = spark.createDataFrame([(1, '[{"a": 1}, {"b": 2}]'), (2, None), (3, "[]")], "id int, j string")
    found = src.explode_records(data, "j", fields={"v": ["a", "b"]}, schema="array<struct<a:int,b:int>>").collect()
    assert [(r["id"], r["index"], r["v"]) for r in found] == [(1, 0, 1), (1, 1, 2)]


def test_align(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    assert select.align(base, base.where("k = 2"), "k").count() == 1
    with pytest.raises(ValueError):
        select.align(base, spark.createDataFrame([(3,)], "k int"), "k")
    with pytest.raises(ValueError):
        select.align(base, base.where("false"), "k")


def test_text_functions(spark):
    r = spark.range(1).select(
        name_key(F.lit("--A b!C--")).alias("n"), name_key(F.lit("!!")).alias("f"), has_word(F.lit("A Cat."), F.lit("cat")).alias("w"),
        has_word(F.lit("cats"), F.lit("cat")).alias("x"), judge_score(F.lit('so {"score": 2} 3')).alias("j"), judge_score(F.lit("none 12")).alias("z"),
    ).first()
    assert (r["n"], r["f"], r["w"], r["x"], r["j"], r["z"]) == ("a_b_c", "item", True, False, 2, None)


def test_upsert_keeps_last(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in catalog.upsert(table, changes, ["k"], F.col("t")).collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_auroc_with_ties(spark):
    data = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert readouts.auroc(data, F.col("y") == 1, "s").first()["auroc"] == 0.875
    assert readouts.auroc(data.where("y = 1"), F.col("y") == 1, "s").first()["auroc"] is None


def test_probe_separates(spark):
    data = spark.createDataFrame([([float(v), float(-v)], int(v > 0)) for v in range(-20, 21) if v], "values array<double>, y int")
    p = readouts.fit_probe(data, "y", 1)
    scored = readouts.probe_scores(data, p["coef"], p["intercept"], p["mean"], p["scale"])
    assert scored.where("predicted_class != y").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:15:00", "click" if i % 2 else "view", float(i)) for i, h in enumerate([0, 0, 1, 2, 3, 9])]
    data = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.hourly(ev.read_events(spark, str(tmp_path / "in"), data.schema))
    ev.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= {tuple(r) for r in ev.hourly(data).collect()}
