"""Cluster order, concept geometry and randomized subspaces against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dialogue
from tessera.operators import geometry, represent


def brute_order(distance):
    """Merge the nearest two clusters, distances being means over all pairs of members, until one is left."""
    clusters = [(i, (i,), (i,)) for i in range(len(distance))]  # label, members, leaves
    step = len(distance)
    while len(clusters) > 1:
        best = None
        for i in range(len(clusters)):
            for j in range(len(clusters)):
                if min(clusters[i][1]) < min(clusters[j][1]):
                    mean = float(np.mean([distance[a, b] for a in clusters[i][1] for b in clusters[j][1]]))
                    key = (round(mean, 12), min(clusters[i][1]), min(clusters[j][1]))
                    best = min(best, (key, i, j)) if best else (key, i, j)
        _, i, j = best
        one, two = sorted((clusters[i], clusters[j]))
        clusters = [c for at, c in enumerate(clusters) if at not in (i, j)] + [(step, one[1] + two[1], one[2] + two[2])]
        step += 1
    return list(clusters[0][2]) if clusters else []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 24])
def test_leaf_order(n):
    rng = np.random.default_rng(n)
    for case in range(20):
        if case % 2:
            d = rng.integers(1, 5, (n, n)).astype(float) * 64  # ties, also after merges
        else:
            d = rng.random((n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        assert geometry.leaf_order(d) == brute_order(d)


def test_concept_geometry(spark):
    rng = np.random.default_rng(3)
    x = {(layer, f"c{i}"): rng.normal(size=5) for layer in (1, 4) for i in range(9)}
    points = spark.createDataFrame([(layer, c, v.tolist()) for (layer, c), v in x.items()] + [(1, "none", None)], "layer int, concept string, vector array<double>")
    got = geometry.concept_geometry(points, 3, 4).collect()
    assert len(got) == 18
    for layer in (1, 4):
        mine = sorted((r for r in got if r["layer"] == layer), key=lambda r: r["concept"])
        m = np.array([x[layer, r["concept"]] for r in mine])
        unit = m / np.linalg.norm(m, axis=1)[:, None]
        order = brute_order(1 - unit @ unit.T)
        assert [mine[i]["position"] for i in order] == list(range(9))
        s = np.linalg.svd(m - m.mean(0))[1] ** 2
        assert np.allclose(mine[0]["explained"], s[:3] / s.sum())
        z = np.array([r["coordinates"] for r in mine])
        assert np.allclose(np.linalg.svd(z)[1] ** 2, s[:3]) and np.allclose(z.mean(0), 0)
        apart = geometry.kmeans(points.where(f"layer = {layer} and vector is not null"), "concept", "vector", 4)
        assert {r["concept"]: r["cluster"] for r in apart.collect()} == {r["concept"]: r["cluster"] for r in mine}
    one = geometry.concept_geometry(points, 2, concepts=["c1", "c2"], layers=[4]).collect()
    assert {r["concept"] for r in one} == {"c1", "c2"} and one[0]["cluster"] is None
    for wrong in ({"concepts": ["c1", "nothing"]}, {"layers": [1, 9]}):
        with pytest.raises(ValueError):
            geometry.concept_geometry(points, **wrong)
    with pytest.raises(ValueError):
        geometry.concept_geometry(points.unionByName(points))


@pytest.mark.parametrize("width, extra, standardize", [(12, 16, True), (64, 16, True), (64, 8, False), (300, 10, True)])
def test_range_subspace(spark, width, extra, standardize):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) + (rng.normal(size=(400, 4)) * [6, 5, 4, 3]) @ rng.normal(size=(4, width)) / 3 + 20
    rows = spark.createDataFrame([(i, f"g{i % 3}", x[i].tolist()) for i in range(400)] + [(400, "g0", None)], "key int, grp string, values array<double>").repartition(5)
    space = represent.range_subspace(rows, 4, standardize, extra)
    z = (x - x.mean(0)) / (x.std(0) if standardize else 1.0)
    values, vectors = np.linalg.eigh(z.T @ z / 400)
    assert np.allclose(space["explained"], values[::-1][:4] / values.sum(), atol=1e-6)
    assert np.allclose(np.abs(np.sum(space["components"] * vectors[:, ::-1][:, :4].T, axis=1)), 1, atol=1e-3)
    assert np.allclose(space["mean"], x.mean(0)) and (space["components"][np.arange(4), np.abs(space["components"]).argmax(1)] > 0).all()
    groups = {r["grp"]: r for r in represent.group_coordinates(rows, "grp", space).collect()}
    for i in range(3):
        assert np.allclose(groups[f"g{i}"]["coordinates"], (z[i::3] @ space["components"].T).mean(0), atol=1e-9)
    assert represent.range_subspace(rows.where("false"), 4)["components"].size == 0


def test_phrases_about_stories_over_line_ends(spark):
    texts = {"A story.\n\nIt was written without using the\n  word itself, as a direct\r\nsynonym would.": "A story.", "A story.\n\nHere are\nthe stories.": "A story.", "One\nparagraph.": "One\nparagraph."}
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["s"] for r in table.select("t", dialogue.trim_story(F.col("t")).alias("s")).collect()} == texts
