"""Canonical JSON, hashes and nested records against the standard library."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import nested as ns
from tessera.sources.examples import index_keys


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def value_of(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return [value_of(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {"".join(rng.choice('abé"\\ Z日') for _ in range(rng.randrange(1, 4))): value_of(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(-(10**6), 10**6), rng.choice([0.1, 1e-5, 1e16, 2.5, -0.0, 123456.789, 1e22, 5e-324, 1.7976931348623157e308]), rng.choice(["", "x", "é\n\t\x01", "😀", '"\\/'])][kind]


def test_canonical_texts(spark):
    rng = random.Random(1)
    values = [value_of(rng, 4) for _ in range(300)]
    table = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)] + [(1000, None)], "i long, t string")
    got = {r["i"]: r["c"] for r in table.select("i", ns.canonical_text(F.col("t")).alias("c")).collect()}
    assert got == {i: canonical(v) for i, v in enumerate(values)} | {1000: None}
    parsed = table.where("i < 1000").withColumn("v", F.parse_json("t"))
    hashes = {r["i"]: r["h"] for r in parsed.select("i", ns.stable_hash(parsed, "v").alias("h")).collect()}
    same = {i for i, v in enumerate(values) if hashes[i] == hashlib.sha256(canonical(v).encode()).hexdigest()}
    # A VARIANT keeps decimal literals as decimals, so numbers such as 1e22 may be written with other digits.
    assert all("e" in canonical(v) or "." in canonical(v) for i, v in enumerate(values) if i not in same) and len(same) > 200


def test_canonical_columns(spark):
    rows = [
        (1, {"b": [1, None], "a": []}, ("z", None, {"k": True}), 2.0, [[1.5e-7], None]),
        (2, {}, None, None, []),
        (3, None, ("é", 5, {}), 1e16, None),
    ]
    table = spark.createDataFrame(rows, "i long, m map<string,array<int>>, s struct<y:string,x:int,w:map<string,boolean>>, d double, n array<array<double>>")
    got = {r["i"]: r for r in table.select("i", *(ns.canonical_json(table, c).alias(c) for c in ("m", "s", "d", "n"))).collect()}
    for i, m, s, d, n in rows:
        struct = None if s is None else {"y": s[0], "x": s[1], "w": s[2]}
        assert [got[i][c] for c in "msdn"] == [canonical(v) for v in (m, struct, d, n)]
    hashed = {r["i"]: r["h"] for r in ns.hash_columns(table, {"h": ["i", "s"]}).collect()}
    assert hashed[1] == hashlib.sha256(canonical({"i": 1, "s": {"y": "z", "x": None, "w": {"k": True}}}).encode()).hexdigest()[:24]
    with pytest.raises(KeyError):
        ns.hash_columns(table, {"h": "nothing"})


def test_nested_records_of_a_dataset(spark):
    rubric = [{"id": "c1", "title": "One", "weight": 2, "annotations": {"rubric_dimension": "Identifying"}}, {"id": "c2", "criterion": "Two", "weight": -3, "annotations": {"RUBRIC_Dimension": "Harmless"}}]
    texts = [json.dumps(rubric), repr(rubric), json.dumps({"x": 1, "criteria": rubric}), json.dumps({"z": rubric[0], "a": rubric[1]}), None, "  ", "[]"]
    table = spark.createDataFrame([(i, f"dilemma {i}", t) for i, t in enumerate(texts)], "i long, dilemma string, rubric string")
    paths = {"criterion_text": ("title", "criterion"), "rubric_dimension": "annotations.rubric_dimension", "criterion_weight": "weight"}
    got = ns.explode_nested(table, "rubric", paths, "place", {"criterion_weight": "int"})
    got = ns.hash_columns(index_keys(got, "rubric", ["i", "place"]), {"base": "dilemma"}).orderBy("example_key").collect()
    assert [(r["example_key"], r["i"], r["place"], r["criterion_text"], r["rubric_dimension"], r["criterion_weight"]) for r in got] == [
        (f"rubric_{2 * k + j:06d}", k, j, t, d, w) for k in range(4) for j, (t, d, w) in enumerate([("One", "Identifying", 2), ("Two", "Harmless", -3)])
    ]
    assert got[0]["base"] == got[1]["base"] == hashlib.sha256(canonical({"dilemma": "dilemma 0"}).encode()).hexdigest()[:24] != got[2]["base"]
    typed = spark.createDataFrame([(1, [("a", 1.5), ("b", None)])], "i int, r array<struct<t:string,w:double>>")
    assert [tuple(r) for r in ns.explode_nested(typed, "r", {"t": "t", "w": "w"}, types={"w": "double"}).select("t", "w").collect()] == [("a", 1.5), ("b", None)]
    variant = table.where("i = 3").withColumn("rubric", F.try_parse_json("rubric"))
    assert [r["t"] for r in ns.explode_nested(variant, "rubric", {"t": paths["criterion_text"]}).collect()] == ["Two", "One"]  # by key


@pytest.mark.parametrize("text", ['"text"', "3", "[1, 2]", '{"a": 1}', '{"criteria": 5}', "{}", "not a literal (", '[{"a": 1}, null]'])
def test_what_is_no_list_of_records(spark, text):
    table = spark.createDataFrame([(text,)], "r string")
    with pytest.raises(Exception):
        ns.explode_nested(table, "r", {"a": "a"}).collect()


def test_paths(spark):
    text = '{"A": {"b": 1, "B": 2, "n": null}, "a": 5, "x": {"y": [1]}, "Q": {"r": 1}, "q": null}'
    table = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    paths = {"A.b": 1, "A.B": 2, "a": 5, "a.b": None, "A.n": None, "x.y": [1], "X.Y": [1], "x.y.z": None, "nothing": None, "Q.R": 1, "q": None}
    got = table.select(*(F.to_json(ns.path_value(F.col("v"), p)).alias(p.replace(".", "_") + str(i)) for i, p in enumerate(paths))).first()
    assert [None if g is None else json.loads(g) for g in got] == list(paths.values())
    assert json.loads(table.select(F.to_json(ns.path_value(F.col("v"), ["A.n", "nothing", "x.y", "a"]))).first()[0]) == [1]
