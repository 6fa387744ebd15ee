"""Imports from JSON, reports and catalogs as files, k-means and the neutral projector against numpy."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, readouts
from tessera.sources import imports


def test_coordinates(spark, tmp_path):
    files = {"a": [3.0, 4.0], "b": [[3.0, 4.0], [0.0, 0.0]], "c": {"axis": [[0.0, 2.0]]}, "d": {"axis": [1.0, 0.0]}}
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    read = lambda n, **k: [tuple(r) for r in imports.read_coordinates(spark, f"{tmp_path}/{n}.json", n, **k).orderBy("layer").collect()]
    assert read("a") == [("a", 0, [0.6, 0.8], [3.0, 4.0], 5.0)]
    assert read("b") == [("b", 0, [0.6, 0.8], [3.0, 4.0], 5.0), ("b", 1, [0.0, 0.0], [0.0, 0.0], 0.0)]
    assert read("b", layer=1) == [("b", 1, [0.0, 0.0], [0.0, 0.0], 0.0)]
    assert read("c") == [("c", 0, [0.0, 1.0], [0.0, 2.0], 2.0)] and read("d")[0][2] == [1.0, 0.0]


def test_vector_space_and_probe(spark, tmp_path):
    space = {"3": {"joy": [1.0, 2.0], "fear": [0.0, 1.0]}, "5": {"joy": [2.0, 2.0]}}
    for name, value in (("x", space), ("y", {"layers": space})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        got = {(r["layer"], r["concept"]): r["vector"] for r in imports.read_vector_space(spark, f"{tmp_path}/{name}.json").collect()}
        assert got == {(3, "joy"): [1.0, 2.0], (3, "fear"): [0.0, 1.0], (5, "joy"): [2.0, 2.0]}
    probe = {"classes": ["n", "y"], "coef": [[1.0, 2.0]], "intercept": [0.5], "mean": [0.0, 0.0], "scale": [1.0, 1.0]}
    (tmp_path / "p.json").write_text(json.dumps(probe, indent=1))
    row = imports.read_probe(spark, f"{tmp_path}/p.json").first()
    assert row["coef"] == [[1.0, 2.0]] and row["threshold"] == 0.5
    for change in ({"classes": ["n"]}, {"coef": []}, {"mean": [0.0]}, {"coef": None}):
        (tmp_path / "q.json").write_text(json.dumps(probe | change))
        with pytest.raises(ValueError):
            imports.read_probe(spark, f"{tmp_path}/q.json")


def test_reports_and_catalogs(spark, tmp_path):
    for i in range(4):
        (tmp_path / "runs").mkdir(exist_ok=True)
        (tmp_path / "runs" / f"{i}.json").write_text(json.dumps({"run_id": f"r{i}", "status": ["done", "failed"][i % 2]}, indent=1))
    done = imports.read_catalog(spark, f"{tmp_path}/runs", "run_id string, status string", {"status": "done", "run_id": None})
    assert {r["run_id"] for r in done.collect()} == {"r0", "r2"}
    imports.write_report({"summary": done}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/summary").count() == 2


def numpy_kmeans(x, k):
    centers = [x[np.argmax(np.linalg.norm(x, axis=1))]]
    while len(centers) < k:
        centers.append(x[np.argmax(np.min([np.linalg.norm(x - c, axis=1) for c in centers], axis=0))])
    centers, labels = np.array(centers), None
    for _ in range(80):
        new = np.argmin(np.linalg.norm(x[:, None] - centers[None], axis=2), axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centers = np.array([x[labels == i].mean(axis=0) if (labels == i).any() else centers[i] for i in range(k)])
    return labels


def test_kmeans_and_orientation(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(12, 3)) + c for c in ([6, 0, 0], [0, 5, 0], [0, 0, -7])])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "name int, vector array<double>").repartition(4)
    got = [r["cluster"] for r in geometry.kmeans(points, "name", "vector", 3).orderBy("name").collect()]
    assert got == numpy_kmeans(x, 3).tolist()
    few = geometry.kmeans(points.where("name < 2"), "name", "vector", 3).orderBy("name").collect()
    assert [r["cluster"] for r in few] == [0, 1]
    named = points.withColumn("name", F.concat(F.lit("n"), F.col("name").cast("string")))
    turned = geometry.oriented(named, "name", "vector", [(["n20"], ["n0"]), (["n15"], ["n0"])]).where("name = 'n0'").first()["vector"]
    assert np.allclose(turned, x[0] * [-1, 1, 1])


def test_neutral_projector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 5)) * [10, 3, 1, 1, 1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, values array<double>")
    parts = geometry.neutral_components(rows, 0.5)
    centered = x - x.mean(axis=0)
    first = np.linalg.svd(centered)[2][0]
    assert parts.shape == (1, 5) and abs(parts[0] @ first) == pytest.approx(1)
    left = np.array([r["values"] for r in geometry.without_neutral(rows, parts).orderBy("key").collect()])
    assert np.allclose(left, x - np.outer(x @ first, first))
    assert geometry.neutral_components(rows.where("key = 0"), 0.5).shape[0] == 0
    with pytest.raises(ValueError):
        geometry.layers_among(rows.withColumn("layer", F.lit(1)), [2])


def test_residuals_of_many_directions(spark):
    """A row costs about as much as its products, which were once worked out anew for each element."""
    rng = np.random.default_rng(8)
    x, nuisance = rng.normal(size=(3000, 64)), rng.normal(size=(25, 64))
    nuisance[3] = nuisance[2] * 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, values array<double>").repartition(4).localCheckpoint()
    began = time.monotonic()
    left = np.array([r["values"] for r in readouts.residual_rows(rows, nuisance).orderBy("key").collect()])
    assert time.monotonic() - began < 12
    q = np.linalg.qr(np.delete(nuisance, 3, axis=0).T)[0]
    assert np.allclose(left, x - x @ q @ q.T)
    odd = [(0, [1.0, 2.0]), (1, None), (2, [3.0, None]), (3, [1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [3.0, 4.0, 5.0])]
    odd = spark.createDataFrame(odd, "key int, values array<double>").coalesce(1)
    got = [r["values"] for r in readouts.residual_rows(odd, np.array([[2.0, 0.0]])).orderBy("key").collect()]
    assert got[:5] == [[0.0, 2.0], None, [None, None], [None, None], [None, None]]
    assert np.isnan(got[5]).all() and got[6] == [None] * 3
    assert [r["values"] for r in readouts.residual_rows(odd.where("key < 3"), np.zeros((1, 2))).orderBy("key").collect()] == [[1.0, 2.0], None, [3.0, None]]
