import math

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, dot, mean_vectors, softmax, top_k, unit
from tessera.operators import patch, project, represent, routing, tokens


def rows(spark):
    data = [("a_neg", "a", "neg", [0.0, 1.0]), ("a_pos", "a", "pos", [2.0, 1.0]), ("b_neg", "b", "neg", [1.0, -2.0]), ("b_pos", "b", "pos", [3.0, -2.0])]
    return spark.createDataFrame(data, "example_key string, pair string, side string, values array<double>")


POS, NEG = "side = 'pos'", "side = 'neg'"


def test_direction(spark):
    r = represent.direction(rows(spark), POS, NEG).first()
    assert (r["raw_vector"], r["vector"], r["norm"], r["n_pos"], r["n_neg"]) == ([2.0, 0.0], [1.0, 0.0], 2.0, 2, 2)


def test_direction_without_a_side_is_empty(spark):
    assert represent.direction(rows(spark).where(POS), POS, NEG).count() == 0


def test_pair_delta(spark):
    assert {r["pair"]: r["values"] for r in represent.pair_delta(rows(spark), "pair", POS, NEG).collect()} == {"a": [2.0, 0.0], "b": [2.0, 0.0]}


def test_mixed_groups(spark):
    assert {r[0] for r in represent.mixed_groups(rows(spark), "pair", POS, NEG).collect()} == {"a", "b"}


def test_centroid_names_null(spark):
    data = rows(spark).withColumn("label", F.when(F.expr(POS), F.lit("p")))
    assert {r["label"]: (r["values"], r["count"]) for r in represent.centroids(data, "label").collect()} == {"p": ([2.5, -0.5], 2), "None": ([0.5, -0.5], 2)}


def test_concept_space_drops_rare(spark):
    space = represent.concept_space(rows(spark), "side", 2).collect()
    assert {r["side"]: r["raw_vector"] for r in space} == {"pos": [1.0, 0.0], "neg": [-1.0, 0.0]}
    assert represent.concept_space(rows(spark), "side", 3).count() == 0


def test_projection_and_summary(spark):
    values = [[1.0, 0.0], [3.0, 0.0], [0.0, 2.0], [0.0, 4.0]]
    toks = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "example_key string, token_pos int, values array<double>")
    axis = spark.createDataFrame([("axis", [1.0, 0.0])], "coordinate string, vector array<double>")
    s = project.summarize(project.scores(toks, axis), ["example_key"], "token_pos").first()
    assert (s["mean"], s["min"], s["max"], s["first_last_delta"]) == (1.0, 0.0, 3.0, -1.0)
    assert math.isclose(s["trend"], -0.6)
    one = project.summarize(project.scores(toks.limit(1), axis), ["example_key"], "token_pos").first()
    assert one["trend"] == 0.0 and one["std"] == 0.0


def test_cosine_of_zero_vector(spark):
    r = spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), unit(F.array(F.lit(0.0))).alias("u")).first()
    assert (r["c"], r["d"], r["u"]) == (0.0, None, [0.0])


def test_mean_vectors_of_nothing(spark):
    assert mean_vectors(rows(spark).where("false"), ["side"], "values").count() == 0


def test_bands(spark):
    scored = spark.createDataFrame([("x", float(i)) for i in range(5)], "k string, score double")
    b = project.quantile_bands(scored, ["k"], "score", 4).first()
    assert b["thresholds"] == [1.0, 2.0, 3.0] and (b["min"], b["max"], b["count"]) == (0.0, 4.0, 5)
    placed = project.assign_band(scored, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "score").orderBy("score").collect()
    assert [r["band"] for r in placed] == [0, 0, 1, 2, 3]


def test_routing(spark):
    r = spark.range(1).select(
        routing.dense_top_k(F.array(F.lit(1), F.lit(3)), F.array(F.lit(0.25), F.lit(0.75)), 4).alias("t"),
        routing.dense_load(F.create_map(F.lit(1), F.lit(2), F.lit(3), F.lit(1)), 4).alias("l"),
        top_k(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)), 2).alias("k"),
        softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"),
    ).first()
    assert r["t"] == [0.0, 0.25, 0.0, 0.75] and r["l"] == [0.0, 2.0, 0.0, 1.0] and r["s"] == [0.5, 0.5]
    assert [x["index"] for x in r["k"]] == [2, 1]


def test_spans(spark):
    pos = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 8, 2)], "example_key string, token_pos int")
    assert {(r["start"], r["stop"]) for r in tokens.contiguous_spans(pos, ["example_key"]).collect()} == {(1, 4), (7, 9)}
    spans = spark.createDataFrame([("a", 1, 4), ("a", 4, 6), ("a", 8, 9), ("a", 2, 3)], "example_key string, start int, stop int")
    assert {(r["start"], r["stop"]) for r in tokens.merge_spans(spans, ["example_key"]).collect()} == {(1, 6), (8, 9)}


def test_patches(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    r = spark.range(1).select(
        patch.project_out(v, [[1.0, 0.0]]).alias("o"),
        patch.add_direction(v, F.array(F.lit(1.0), F.lit(1.0)), 2.0).alias("a"),
        patch.swap_components(v, F.array(F.lit(9.0), F.lit(9.0)), v, [[0.0, 1.0]]).alias("s"),
    ).first()
    assert (r["o"], r["a"], r["s"]) == ([0.0, 4.0], [5.0, 6.0], [3.0, 9.0])


def test_pairing_reasons(spark):
    data = [(1, "t", "x"), (1, "d", "y"), (2, "t", "x"), (3, "d", "y"), (4, "t", "x"), (4, "t", "z"), (4, "d", "y")]
    found = patch.pair_cases(spark.createDataFrame(data, "case_id int, side string, example_key string"), "case_id", F.col("side") == "t", F.col("side") == "d")
    assert {r["case_id"]: r["reason"] for r in found.collect()} == {1: None, 2: "no donor", 3: "no target", 4: "several targets"}


def test_subspace_of_a_line(spark):
    data = spark.createDataFrame([([float(i), 2.0 * i],) for i in range(10)], "values array<double>")
    space = represent.subspace(data, 1, standardize=False)
    assert abs(space["explained"][0] - 1) < 1e-9
    assert [round(float(x), 6) for x in space["components"][0]] == [0.447214, 0.894427]
