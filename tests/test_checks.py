"""Selections that must be whole, strict labels, spaces without neutral parts, and models as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import represent, select, solver, tokens


def test_sections_and_positions(spark):
    rows = [(e, p, [float(p), float(len(e))]) for e in ("a", "bb") for p in (3, 1, 2, 7)]
    table = spark.createDataFrame(rows, "example_key string, token_pos int, values array<double>")
    whole = tokens.full_sequence(table).where("example_key = 'a'").orderBy("index").collect()
    assert [(r["token_pos"], r["index"], r["n_tokens"]) for r in whole] == [(1, 0, 4), (2, 1, 4), (3, 2, 4), (7, 3, 4)]
    sections = spark.createDataFrame([("a", "x", 1), ("bb", "x", 7), ("bb", "x", 2), ("a", "y", 3), ("bb", "y", 99)], "example_key string, section string, token_pos int")
    assert sorted((r["example_key"], r["token_pos"]) for r in tokens.select_section(table, sections, "x").collect()) == [("a", 1), ("bb", 2), ("bb", 7)]
    with pytest.raises(ValueError, match="bb"):
        tokens.select_section(table, sections, "y")
    listed = spark.createDataFrame([("a", 0, 7), ("a", 1, 1), ("a", 2, 7), ("bb", 0, 2)], "example_key string, place int, token_pos int")
    pooled = lambda how: {r["example_key"]: (r["values"][0], r["n_tokens"]) for r in tokens.pool_positions(table, listed, ["example_key"], how).collect()}
    assert pooled("mean") == {"a": (5.0, 3), "bb": (2.0, 1)} and pooled("first") == {"a": (7.0, 3), "bb": (2.0, 1)} and pooled("last")["a"] == (7.0, 3)
    with pytest.raises(Exception, match="no token at position 5"):
        tokens.pool_positions(table, listed.withColumn("token_pos", F.lit(5)), ["example_key"]).collect()


def test_sections_without_tokens(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 8)], "key int, token_pos int, start int, stop int")
    spans = spark.createDataFrame([(1, "s", 2, 6), (1, "empty", 3, 3)], "key int, name string, begin int, end int")
    assert sorted(r["token_pos"] for r in tokens.section_tokens(spans.where("name = 's'"), pieces, "key").collect()) == [0, 1]
    with pytest.raises(ValueError, match="far"):
        tokens.section_tokens(spans.unionByName(spark.createDataFrame([(1, "far", 9, 12)], spans.schema)), pieces, "key")


def test_strict_labels(spark):
    rows = spark.createDataFrame([("a", '{"x": 1, "y": null}'), (None, '{"x": "t", "y": 2}')], "label string, fields string")
    assert [r["mapped"] for r in select.map_label(rows, "label", {"a": "A", "None": "N"}, strict=True).collect()] == ["A", "N"]
    assert [r["mapped"] for r in select.map_label(rows, "label", {}, "d").collect()] == ["d", "d"]
    with pytest.raises(Exception, match="no entry for None"):
        select.map_label(rows, "label", {"a": "A"}, strict=True).collect()
    assert [(r["p"], r["q"]) for r in select.label_fields(rows, "fields", {"p": "x", "q": "y"}, strict=True).collect()] == [("1", None), ("t", "2")]
    with pytest.raises(Exception, match="no field z"):
        select.label_fields(rows, "fields", {"p": "z"}, strict=True).collect()


def test_spaces_without_neutral_parts(spark):
    rng = np.random.default_rng(4)
    x, concept = rng.normal(size=(40, 5)), [f"c{i % 4}" if i < 38 else "rare" for i in range(40)]
    rows = spark.createDataFrame([(i % 2, concept[i], x[i].tolist()) for i in range(40)], "layer int, concept string, values array<double>")
    basis = np.linalg.qr(rng.normal(size=(5, 2)))[0].T
    got = {(r["layer"], r["concept"]): r for r in represent.concept_space(rows, "concept", 3, ["layer"], {1: basis}).collect()}
    for layer in (0, 1):
        means = {c: x[[i for i in range(40) if i % 2 == layer and concept[i] == c]].mean(0) for c in {concept[i] for i in range(38) if i % 2 == layer}}
        center = np.mean(list(means.values()), axis=0)
        for c, m in means.items():
            raw = m - center
            raw = raw - (raw @ basis.T) @ basis if layer else raw
            assert np.allclose(got[layer, c]["raw_vector"], raw) and got[layer, c]["norm"] == pytest.approx(np.linalg.norm(raw))
    assert {(r["layer"], r["concept"], r["count"]) for r in represent.dropped_concepts(rows, "concept", 3, ["layer"]).collect()} == {(0, "rare", 1), (1, "rare", 1)}
    assert represent.concept_space(rows, "concept", 100).count() == 0


def test_models_as_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    y, c = (x[:, 0] > 0).astype(int), np.clip((x[:, 1] + 1.5).astype(int), 0, 2)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), int(c[i])) for i in range(90)], "key int, values array<double>, y int, c int")
    tasks = [solver.Task(("y",), F.lit(True), F.lit(True), F.col("y"), 2), solver.Task(("c",), F.lit(True), F.lit(True), F.col("c"), 3), solver.Task(("none",), F.lit(False), F.lit(True), F.col("c"), 3)]
    models = solver.fit_tasks(rows, tasks, cs=[0.5, 2.0])
    labels = [["n", "p"], ["a", "b", "c"], ["a", "b", "c"]]
    solver.model_table(spark, models, labels).write.parquet(str(tmp_path / "models"))
    back, classes = solver.read_models(spark.read.parquet(str(tmp_path / "models")))
    assert classes == {0: labels[0], 1: labels[1]} and len(back) == 4
    scored = lambda m: sorted(map(str, solver.score_tasks(rows, "key", tasks, m).collect()))
    assert scored(back) == scored(models) and len(scored(back)) == 360
    table = spark.read.parquet(str(tmp_path / "models"))
    for wrong in (table.withColumn("intercept", F.array(F.lit(1.0), F.lit(2.0))), table.withColumn("classes", F.array(F.lit("a"))), table.withColumn("mean", F.array(F.lit(1.0)))):
        with pytest.raises(ValueError):
            solver.read_models(wrong)
