"""Scores of tokens by blocks and tiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    x = {(f"e{e}", layer, t): rng.normal(size=4 if layer == 1 else 6) for e in range(40) for layer in (1, 2) for t in range(5)}
    x["e0", 1, 0] = np.zeros(4)
    c = {(layer, f"c{i}"): rng.normal(size=4 if layer == 1 else 6) for layer in (1, 2) for i in range(7)}
    rows = [(e, layer, t, f"c{int(e[1:]) % 9}", v.tolist(), "low" if int(e[1:]) % 2 else "high", f"t{t}") for (e, layer, t), v in x.items()]
    rows += [("e0", 3, 0, "c0", [1.0], "low", ""), ("e1", 1, 9, "c0", None, "low", ""), ("e2", 1, 7, None, [1.0] * 4, "low", "")]
    table = spark.createDataFrame(rows, "example_key string, layer int, token_pos int, own string, values array<double>, side string, piece string").repartition(6)
    points = spark.createDataFrame([(layer, n, v.tolist()) for (layer, n), v in c.items()] + [(1, "none", None)], "layer long, coordinate string, vector array<double>")
    x["e2", 1, 7] = np.ones(4)
    return x, c, table, points


def plain(x, c, metric):
    def score(a, b):
        if metric == "dot":
            return a @ b
        length = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / length if length else 0.0

    return {(e, layer, t, n): score(v, w) for (e, layer, t), v in x.items() for (at, n), w in c.items() if at == layer}


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("most, block, tile", [(10**6, 512, 256), (10**6, 3, 2), (0, 512, 256), (0, 3, 2)])
def test_dense_scores(tables, monkeypatch, metric, most, block, tile):
    for name, value in (("BROADCAST_NUMBERS", most), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(dense, name, value)
    x, c, table, points = tables
    want = plain(x, c, metric)
    got = dense.dense_scores(table, points, metric).collect()
    found = {(r["example_key"], r["layer"], r["token_pos"], r["coordinate"]): r["score"] for r in got}
    assert len(got) == len(found) and found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())
    own = {(r["example_key"], r["layer"], r["token_pos"]): (r["coordinate"], r["score"]) for r in dense.dense_scores(table, points, metric, "own").collect()}
    named = {(e, layer, t): f"c{int(e[1:]) % 9}" for e, layer, t in x if int(e[1:]) % 9 < 7 and t != 7}
    assert {k: n for k, (n, _) in own.items()} == named and all(abs(s - want[(*k, n)]) < 1e-12 for k, (n, s) in own.items())


def test_series_and_sides(tables):
    x, c, table, points = tables
    want = plain(x, c, "cosine")
    scores = dense.dense_scores(table, points, keep=["example_key", "token_pos", "side", "piece"])
    series = {(r["example_key"], r["layer"], r["coordinate"]): r for r in dense.token_series(scores).collect()}
    for (e, layer, n), r in series.items():
        places = sorted(t for k, at, t in x if k == e and at == layer)
        assert r["token_positions"] == places and np.allclose(r["scores"], [want[e, layer, t, n] for t in places])
    two = scores.where("example_key in ('e3', 'e4')")
    for r in dense.side_deltas(two, F.col("side"), "low", "high", label="piece").collect():
        a, b = want["e3", r["layer"], r["token_pos"], r["coordinate"]], want["e4", r["layer"], r["token_pos"], r["coordinate"]]
        assert r["delta"] == pytest.approx(b - a) and r["baseline_score"] == pytest.approx(a) and r["token_label"] == f"t{r['token_pos']}"
    assert dense.side_deltas(two.where("side = 'low'"), F.col("side"), "low", "high").count() == 0


def test_single_tokens(tables):
    x, c, table, points = tables
    rows = table.where("token_pos = 2")
    got = {(r["example_key"], r["layer"], r["coordinate"]): r["score"] for r in dense.single_token_scores(rows, points, ["c0", "c3"], [2]).collect()}
    want = plain(x, c, "cosine")
    assert got.keys() == {(f"e{e}", 2, n) for e in range(40) for n in ("c0", "c3")} and all(got[e, layer, n] == pytest.approx(want[e, layer, 2, n]) for e, layer, n in got)
    with pytest.raises(ValueError, match="missing"):
        dense.single_token_scores(rows, points, ["c0", "c9"], [1, 2])
    with pytest.raises(Exception, match="widths|numbers on"):
        dense.dense_scores(rows, points.where("layer = 2").withColumn("layer", F.lit(1))).count()
    with pytest.raises(ValueError, match="metric"):
        dense.dense_scores(rows, points, "l2")
    assert dense.dense_scores(rows, points.where("false")).count() == 0
