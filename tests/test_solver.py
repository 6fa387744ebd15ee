"""Many models at once against a numpy fit of each; splits, cohorts, residuals, stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.operators import solver


def numpy_fit(x, y, k, penalty, iterations=200):
    """Balanced logistic regression on standardized x by Newton's method: coefficients on x as it is."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    counts = np.bincount(y, minlength=k)
    s = (len(y) / ((counts > 0).sum() * np.maximum(counts, 1)))[y]
    outputs, d = (1 if k == 2 else k), z.shape[1]
    w, ridge = np.zeros(outputs * d), np.tile(np.append(np.full(d - 1, penalty), 0.0), outputs)
    for _ in range(iterations):
        logits = z @ w.reshape(outputs, d).T
        if outputs == 1:
            p = 1 / (1 + np.exp(-logits))
            g = z.T @ (s * (p[:, 0] - y))
            h = (z.T * (s * p[:, 0] * (1 - p[:, 0]))) @ z
        else:
            e = np.exp(logits - logits.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            g = ((p - np.eye(k)[y]) * s[:, None]).T @ z
            g = g.ravel()
            h = np.block([[(z.T * (s * p[:, a] * ((a == b) - p[:, b]))) @ z for b in range(k)] for a in range(k)])
        w = w - np.linalg.lstsq(h + np.diag(ridge), g + ridge * w, rcond=1e-12)[0]
    w = w.reshape(outputs, d)
    coef = w[:, :-1] / scale
    return coef, w[:, -1] - coef @ mean


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n, d = 600, 5
    x = rng.normal(size=(n, d)) * [1, 3, 0.2, 1, 10] + [0, 5, -2, 0, 40]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 5) + rng.normal(size=n) > 0.4).astype(int)
    c = np.clip(((x[:, 3] + rng.normal(size=n) * 0.7) * 1.2 + 1.5).astype(int), 0, 2)
    cohort, part = rng.choice(["a", "b", "c"], n), rng.choice(["train", "dev", "test"], n)
    rows = [(i, x[i].tolist(), int(y[i]), f"c{c[i]}", str(cohort[i]), str(part[i]), str(part[(i * 7) % n])) for i in range(n)]
    rows += [(n, x[0].tolist(), None, None, "a", "train", "test"), (n + 1, None, 1, "c1", "a", "test", "train")]
    frame = spark.createDataFrame(rows, "key long, values array<double>, y int, kind string, cohort string, split string, other string").repartition(5)
    return x, y, c, cohort, part, frame


@pytest.mark.parametrize("hessian", [True, False])
def test_many_models_equal_numpy(data, monkeypatch, hessian):
    x, y, c, cohort, part, rows = data
    if not hessian:
        monkeypatch.setattr(solver, "MOST_HESSIAN", 0)
    kinds = ev.class_number("kind", ["c0", "c1", "c2"])
    tasks = [solver.Task((n,), F.col("cohort") == n, F.col("cohort") != n, F.col("y"), 2) for n in "abc"]
    tasks += [solver.Task(("kind",), F.col("split") == "train", F.col("split") == "test", kinds, 3)]
    tasks += [solver.Task(("none",), F.col("cohort") == "zzz", F.lit(True), F.col("y"), 2), solver.Task(("one",), F.col("y") == 1, F.lit(True), F.col("y"), 2)]
    models = solver.fit_tasks(rows, tasks, cs=[0.1, 1.0, 10.0], max_iter=60)
    assert len(models) == 18 and [m.fitted for m in models] == [True] * 12 + [False] * 6
    for m in models[:12]:
        own = cohort == "abc"[m.task] if m.task < 3 else part == "train"
        target, k = (y, 2) if m.task < 3 else (c, 3)
        coef, intercept = numpy_fit(x[own], target[own], k, 1 / m.strength, 30)
        tolerance = 1e-5 if hessian else 2e-3
        assert np.allclose(m.coef, coef, atol=tolerance, rtol=tolerance) and m.n_train == own.sum()
        assert np.allclose(m.intercept - m.intercept.mean(), intercept - intercept.mean(), atol=10 * tolerance) if k > 2 else np.allclose(m.intercept, intercept, atol=20 * tolerance)
    scored = solver.score_tasks(rows, "key", tasks, models).where("strength = 1.0").collect()
    assert {r["task"] for r in scored} == {0, 1, 2, 3}
    for m in models:
        if m.fitted and m.strength == 1.0:
            mine = {r["key"]: r for r in scored if r["task"] == m.task}
            test = cohort != "abc"[m.task] if m.task < 3 else part == "test"
            assert set(mine) == set(np.flatnonzero(test))
            z = x @ m.coef.T + m.intercept
            best = (z[:, 0] > 0).astype(int) if m.task < 3 else z.argmax(1)
            assert all(r["predicted_index"] == best[i] and abs(sum(r["probabilities"]) - 1) < 1e-9 for i, r in mine.items())


def test_transfer_split(data):
    x, y, c, cohort, part, rows = data
    got = ev.transfer_split(rows, "key", "kind", ["split", "other"], ["train", "dev"], ["test"], [0.5, 5.0], "cohort").collect()
    assert len(got) == 12 and {(r["split_name"], r["cohort"], r["c"]) for r in got} == {(s, n, v) for s in ("split", "other") for n in "abc" for v in (0.5, 5.0)}
    for r in got:
        if r["split_name"] != "split":
            continue
        train, test = (cohort == r["cohort"]) & (part != "test"), (cohort == r["cohort"]) & (part == "test")
        coef, intercept = numpy_fit(x[train], c[train], 3, 1 / r["c"], 30)
        z = x[test] @ coef.T + intercept
        right = z.argmax(1) == c[test]
        assert r["accuracy"] == pytest.approx(right.mean()) and (r["n_train"], r["n_test"]) == (train.sum(), test.sum())
        assert r["balanced_accuracy"] == pytest.approx(np.mean([right[c[test] == k].mean() for k in np.unique(c[test])]))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        areas = [np.mean([(a > b) + (a == b) / 2 for a in p[c[test] == k, k] for b in p[c[test] != k, k]]) for k in range(3)]
        assert r["auroc"] == pytest.approx(np.mean(areas), abs=2e-3)
    whole = ev.transfer_split(rows, "key", "y", ["split"], ["train"], ["test"]).first()
    assert whole["cohort"] is None and whole["tp"] + whole["fp"] + whole["fn"] + whole["tn"] == whole["n_test"] == (part == "test").sum()
    assert ev.transfer_split(rows, "key", "y", ["split"], ["train"], ["test"], predictions=True).count() == (part == "test").sum()
    empty = ev.transfer_split(rows, "key", "y", ["split"], ["train"], ["nothing"]).first()
    assert empty["accuracy"] is None and empty["n_test"] == 0
    with pytest.raises(ValueError, match="both sides"):
        ev.transfer_split(rows, "key", "y", ["split"], ["train"], ["test"], group="cohort")


def test_cross_validation_of_classes(data):
    _, _, _, _, _, rows = data
    r = ev.cross_validate(rows.where("values is not null"), "key", "kind", folds=3).first()
    assert r["n_folds"] == 3 and r["accuracy_mean"] > r["majority"] > 0.3 and r["auroc_mean"] > 0.7
    assert abs(r["shuffled"] - 1 / 3) < 0.12 and r["selectivity"] == pytest.approx(r["accuracy_mean"] - r["shuffled"])


def test_residual_directions_are_those_of_the_training_rows(data):
    x, y, _, _, part, rows = data
    without = np.array([[1.0, 0.0, 0.0, 0.0, 0.0], [2.0, 0.0, 0.0, 0.0, 0.0]])
    task = solver.Task((), F.col("split") != "test", F.col("split") == "test", F.col("y"), 2, without=without)
    m = solver.fit_tasks(rows, [task], cs=[1.0])[0]
    left = x.copy()
    left[:, 0] = 0
    coef, intercept = numpy_fit(left[part != "test"], y[part != "test"], 2, 1.0, 30)
    assert np.allclose(m.coef[:, 1:], coef[:, 1:], atol=1e-5) and abs(m.coef[0, 0]) < 1e-9 and np.allclose(m.intercept, intercept, atol=1e-4)


def twin(x, y, keys, stages, epochs, alpha, rate, batch_of, batches):
    """solver.staged() of two classes in numpy; batch_of(epoch, key) deals the rows."""
    union = np.logical_or.reduce(stages)
    mean, scale = x[union].mean(0), x[union].std(0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    counts = np.bincount(y[union], minlength=2)
    s = (union.sum() / (2 * counts))[y]
    w, t, epoch = np.zeros(z.shape[1]), 0, 0
    for stage, n in zip(stages, epochs):
        for _ in range(n):
            dealt = batch_of(epoch, keys)
            for b in range(batches):
                own = stage & (dealt == b)
                if own.any():
                    p = 1 / (1 + np.exp(-z[own] @ w))
                    g = z[own].T @ (s[own] * (p - y[own])) / own.sum()
                    w = w - rate / (1 + alpha * rate * t) * (g + alpha * np.append(w[:-1], 0))
                    t += 1
            epoch += 1
    return w, t


def test_staged_training_equals_numpy(spark, data):
    x, y, _, _, part, rows = data
    model = solver.staged(rows, "key", [F.col("split") == "train", F.col("split") == "dev"], F.col("y"), 2, [2, 3], 0.01, 0.5, 3, 9)
    dealt = {e: np.array([r[0] for r in spark.range(len(x)).select(F.pmod(F.xxhash64(F.lit(9), F.lit(e), F.col("id")), F.lit(3))).collect()]) for e in range(5)}
    w, steps = twin(x, y, np.arange(len(x)), [part == "train", part == "dev"], [2, 3], 0.01, 0.5, lambda e, _: dealt[e], 3)
    assert model.iterations == steps == 15 and np.allclose(model.standard[0], w[:-1], atol=1e-9)


def test_staged_fine_tuning(spark):
    values = {"synthetic": [-8, -7, -6, -5, 5, 6, 7, 8], "dev": [-4, -3, 3, 4], "unseen": [-10, -9, 9, 10]}
    rows = spark.createDataFrame([(f"{s}{v}", [float(v), float(-v)], "negative" if v < 0 else "positive", s) for s, vs in values.items() for v in vs], "key string, values array<double>, side string, split string")
    scored, model = ev.staged_fine_tune(rows, "key", "side", "split", [["synthetic"], ["dev"]], ["unseen"], [1, 3], batches=2)
    got = scored.collect()
    assert len(got) == 4 and all(r["true_label"] == r["predicted_label"] for r in got) and model.n_train == 12
    for stages, epochs in (([["synthetic"], ["nothing"]], []), ([["synthetic"]], [1, 2]), ([["synthetic"]], [0])):
        with pytest.raises(ValueError):
            ev.staged_fine_tune(rows, "key", "side", "split", stages, ["unseen"], epochs)
    with pytest.raises(ValueError, match="one class"):
        ev.staged_fine_tune(rows.where("side = 'positive'"), "key", "side", "split", [["synthetic"]], ["unseen"], classes=["negative", "positive"])
