"""Moments, folds, controls and probe evaluation; dialogue functions; streams against their batch form."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dialogue as dl
from tessera.functions.text import json_hash, json_string, messages_hash
from tessera.functions.vectors import rounded
from tessera.operators import evaluate as ev
from tessera.operators import patch, project, readouts, represent, tokens
from tessera.sources import examples as src
from tessera.streaming import events


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 6))
    x[:, 0] += np.where(np.arange(240) % 2 == 0, 3.0, -3.0)
    rows = [(i, "pos" if i % 2 == 0 else "neg", f"g{i % 30}", ["a", "b"][i // 120], int(x[i, 1] > 0), x[i].tolist()) for i in range(240)]
    return x, spark.createDataFrame(rows, "key long, side string, grp string, cohort string, nuisance int, values array<double>").repartition(5)


def test_moments(spark, points):
    x, rows = points
    n, mean, cov = represent.moments(rows)
    assert n == 240 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert represent.moments(rows.where("false"))[0] == 0
    space = represent.subspace(rows, 3)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert np.allclose(space["explained"], values[:3] / values.sum())


def test_stratified_folds(points):
    _, rows = points
    found = ev.stratified_folds(rows, "key", "side", 4).groupBy("fold", "side").count().collect()
    assert {r["count"] for r in found} == {30} and len(found) == 8
    grouped = ev.stratified_folds(rows, "key", "side", 3, group="grp")
    assert readouts.leaking_groups(grouped, "grp", "fold").count() == 0 and grouped.count() == 240
    assert ev.fold_count(rows, "side", 5) == 5 and ev.fold_count(rows.where("key < 6"), "side", 5) == 3


def test_shuffled_labels_are_a_permutation(points):
    _, rows = points
    mixed = ev.shuffled_labels(rows, "key", "side", 7)
    assert {r["shuffled"]: r["count"] for r in mixed.groupBy("shuffled").count().collect()} == {"pos": 120, "neg": 120}
    assert 60 < mixed.where("side = shuffled").count() < 180


def test_cross_validation_tells_signal_from_chance(points):
    _, rows = points
    r = ev.cross_validate(rows, "key", "side", "pos", 3).first()
    assert r["accuracy_mean"] > 0.95 and r["n_folds"] == 3 and r["majority"] == 0.5
    assert r["shuffled"] < 0.7 and abs(r["selectivity"] - (r["accuracy_mean"] - r["shuffled"])) < 1e-12


def test_transfer_and_residualized(points):
    _, rows = points
    found = {(r["train_cohort"], r["test_cohort"]): r for r in ev.transfer(rows, "key", "cohort", "side", "pos", 2).collect()}
    assert len(found) == 4 and all(r["accuracy"] > 0.9 for r in found.values())
    assert found["a", "b"]["cosine"] == pytest.approx(found["b", "a"]["cosine"]) and found["a", "a"]["delta"] == 0
    r = ev.residualized(rows, "key", "side", "pos", "nuisance", [1], 2).first()
    assert r["raw"] > 0.95 and r["null"] > 0.9 and r["rank"] == 1 and r["nuisance"] < 0.75 and r["leaks"] is False


def test_multiclass_scores(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "key int, values array<double>")
    got = ev.multiclass_scores(rows, [[2.0, 0.0], [0.0, 1.0], [2.0, 0.0]], [0.0, 0.0, 0.0], [0.0, 0.0], [1.0, 0.0]).orderBy("key").collect()
    e = np.exp([2.0, 0.0, 2.0])
    assert np.allclose(got[0]["probabilities"], e / e.sum()) and [r["predicted_class"] for r in got] == [0, 0]
    assert got[0]["score"] == pytest.approx(e[2] / e.sum())


def test_auroc_and_bands_over_ranges(spark):
    rng = np.random.default_rng(5)
    score, truth = rng.integers(0, 40, 500) / 4, rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, truth)], "score double, truth int").repartition(6)
    wins = sum((a > b) + (a == b) / 2 for a in score[truth == 1] for b in score[truth == 0])
    got = readouts.auroc(rows, F.col("truth") == 1, "score").first()["auroc"]
    assert got == pytest.approx(wins / (truth.sum() * (1 - truth).sum()))
    band = project.quantile_bands(rows, ["truth"], "score", 5).collect()
    for r in band:
        own = score[truth == r["truth"]]
        assert np.allclose(r["thresholds"], np.quantile(own, [0.2, 0.4, 0.6, 0.8])) and r["count"] == len(own)
    assert np.allclose(project.quantile_bands(rows, [], "score", 4).first()["thresholds"], np.quantile(score, [0.25, 0.5, 0.75]))


def test_scores_with_many_coordinates(spark, points, monkeypatch):
    _, rows = points
    axes = spark.createDataFrame([(f"c{i}", [float(i)] * 6) for i in range(30)], "coordinate string, vector array<double>")
    few = {(r["key"], r["coordinate"]): r["score"] for r in project.scores(rows, axes).collect()}
    many = spark.range(10_050).select(F.format_string("c%d", "id").alias("coordinate"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("id").cast("double")).alias("vector"))
    part = project.scores(rows.where("key < 3"), many)
    assert part.count() == 3 * 10_050
    assert all(r["score"] == pytest.approx(few[r["key"], r["coordinate"]]) for r in part.where("coordinate in ('c1', 'c29')").collect())


def test_rounding_halves_to_even(spark):
    got = spark.range(1).select(*(rounded(F.lit(x), 4).alias(f"c{i}") for i, x in enumerate((0.03125, 0.09375, -0.03125)))).first()
    assert tuple(got) == (0.0312, 0.0938, -0.0312)


def test_random_control(spark):
    random = patch.random_components(2, 5, 1, 3)
    assert np.allclose(random @ random.T, np.eye(2)) and np.allclose(random, patch.random_components(2, 5, 2, 2))
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    axes = np.eye(5)[:2]
    ones, zero = [1.0] * 5, [0.0] * 5
    v = F.col("v")
    got = rows.select(patch.random_control(v, v, axes, random, zero, ones, ones).alias("a"), patch.project_out_standardized(v, v, axes, zero, ones, ones).alias("b")).first()
    moved = lambda x: np.linalg.norm(np.array(x) - [1, 2, 3, 4, 5])
    assert moved(got["a"]) == pytest.approx(moved(got["b"])) == pytest.approx(5**0.5)


def test_slices_and_missing_sections(spark):
    rows = spark.createDataFrame([("a", i, [float(i)]) for i in range(4)] + [("b", 0, [9.0])], "example_key string, token_pos int, values array<double>")
    at = lambda *cut: sorted((r["example_key"], r["token_pos"]) for r in tokens.slice_tokens(rows, *cut).collect())
    assert at(-2, None) == [("a", 2), ("a", 3), ("b", 0)] and at(0, -1) == [("a", 0), ("a", 1), ("a", 2)] and at(1, 3) == [("a", 1), ("a", 2)]
    sections = spark.createDataFrame([("a", "head", 0)], "example_key string, section string, token_pos int")
    assert [r[0] for r in tokens.missing_sections(rows, sections, "head").collect()] == ["b"]


def test_expand_prompts_gives_every_pair(spark):
    a = spark.createDataFrame([(i, f"You are {{model_name}} {i}") for i in range(5)], "instruction_id int, instruction string")
    b = spark.createDataFrame([(i, f"q{i}") for i in range(40)], "question_id int, question string")
    got = src.expand_prompts(a, b, "toy").collect()
    assert len({r["example_key"] for r in got}) == len(got) == 200 and {r["instruction"] for r in got} == {f"You are toy {i}" for i in range(5)}


def test_story_rules(spark):
    cases = {
        "Once.\n\nPlease note that this is it.\n\nMore": "Once.",
        "Noted was the day.\n\nHere are 3 stories.": "Noted was the day.",
        "A tale. I hope you like them.\n\nNext": "A tale.",
        "A tale I hope to tell.\n\nEnd.": "A tale I hope to tell.\n\nEnd.",
        "One.\n\n\nTwo. Please disregard this.": "One.\n\nTwo.",
        "The stories aim high": "",
        "": "",
    }
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", dl.trim_story(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_dialogues(spark):
    cases = [("Person: a\nAI: b\nPerson:", [("Person", "a"), ("AI", "b")]), ("AI: a\nPerson: b", None), ("Person: a", None), ("x\nPerson : a b\n\nAI:\nc", [("Person", "a b"), ("AI", "c")])]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = {r["t"]: r["d"] and [tuple(x) for x in r["d"]] for r in rows.select("t", dl.dialogue_turns(F.col("t")).alias("d")).collect()}
    assert got == dict(cases)
    colons = {"hi assistant: x": 12, "Assistant\nx": 9, "assistant: a assistant\nb: c": 24, "none": -1}
    rows = spark.createDataFrame(list(colons.items()), "t string, at int")
    assert all(r["at"] == r["got"] for r in rows.select("at", dl.assistant_colon(F.col("t")).alias("got")).collect())


def test_streams_equal_their_batch_form(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(400)
    table.unionByName(table.limit(50)).repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    for name, plan, keys in (("s", events.sessions, ["user_id", "start", "end", "n"]), ("f", events.first_events, ["event_id"])):
        stream = plan(events.read_events(spark, f"{tmp_path}/in", table.schema, files_per_batch=10))
        run = events.write_batches(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-at")
        assert run.awaitTermination(120)
        done = set(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").select(*keys).collect()))
        whole = set(map(tuple, plan(spark.read.parquet(f"{tmp_path}/in")).select(*keys).collect()))
        assert done and done <= whole and (name == "s" or done == whole)


def test_json_strings(spark):
    texts = ["", "plain", 'a"b\\c', "\n\r\t\b\f\x01\x1f\x7f", "é日\u2028", "😀x𝄞", "\u00a0'"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j"), json_hash(F.col("t")).alias("h")).collect()
    assert all(r["j"] == json.dumps(r["t"]) and r["h"] == hashlib.sha256(json.dumps(r["t"]).encode()).hexdigest() for r in rows)
    message = [{"role": "user", "content": "é"}, {"role": "x", "content": ""}]
    got = spark.createDataFrame([(message,)], "m array<struct<role:string,content:string>>").select(messages_hash(F.col("m")).alias("h")).first()["h"]
    assert got == hashlib.sha256(json.dumps(message, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
