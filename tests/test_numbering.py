"""Numbers, ranks and what rests on them, over more rows than a range sample holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, project, readouts
from tessera.sources.examples import index_keys, number_rows, ranked

N = 300_000


@pytest.fixture(scope="module")
def many(spark):
    key = F.xxhash64("id")
    return spark.range(N).select(key.alias("key"), F.pmod(key, F.lit(7)).alias("group"), F.repeat(F.lit("payload "), 5).alias("text"), F.when(F.col("id") % 3 > 0, F.pmod(key, F.lit(1000))).alias("tied"))


@pytest.mark.parametrize("parts", ["2", "4", "16"])
def test_numbers_are_distinct(spark, many, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for _ in range(2):
            got = number_rows(many, ["key"]).select("key", "ord").toPandas().sort_values("key")
            assert (got["ord"].to_numpy() == np.arange(N)).all()
        got = number_rows(many, ["tied"]).select("tied", "ord").toPandas().sort_values("ord")
        assert (got["ord"].to_numpy() == np.arange(N)).all() and got["tied"].isna().to_numpy()[: got["tied"].isna().sum()].all()
        assert got["tied"].dropna().is_monotonic_increasing
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_in_groups(many):
    got = ranked(many, ["group"], ["key"]).select("group", "key", "rank").toPandas().sort_values(["group", "key"])
    assert (got["rank"] == got.groupby("group").cumcount()).all()
    got = ranked(many.withColumn("group", F.when(F.col("group") > 0, F.col("group"))), ["group"], ["key"])
    assert got.count() == N and got.where("group is null").agg(F.max("rank")).first()[0] == got.where("group is null").count() - 1


def test_keys_and_shuffled_labels(many):
    assert index_keys(many, "x", ["key"]).select("example_key").distinct().count() == N
    got = evaluate.shuffled_labels(many.limit(50_000), "key", "group", 3)
    counts = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
    assert got.count() == 50_000 and counts(got, "group") == counts(got, "shuffled")


def test_auroc_of_many_scores(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    truth, score = rng.integers(0, 2, n), np.round(rng.normal(size=n), 3)
    score[truth == 1] += 0.25
    import pandas as pd

    order = pd.Series(score).rank().to_numpy()
    pos = truth.sum()
    want = (order[truth == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    rows = spark.createDataFrame(pd.DataFrame({"score": score, "truth": truth, "k": "a"})).repartition(8)
    assert readouts.auroc(rows, F.col("truth") == 1, "score", ["k"]).first()["auroc"] == pytest.approx(want, abs=1e-12)
    assert readouts.auroc(rows, F.col("truth") == 1, "score").first()["auroc"] == pytest.approx(want, abs=1e-12)
    bands = project.quantile_bands(rows.withColumn("truth", F.col("truth").cast("string")), ["truth"], "score", 7).collect()
    for r in bands:
        own = score[truth == int(r["truth"])]
        assert np.allclose(r["thresholds"], np.quantile(own, np.arange(1, 7) / 7)) and (r["min"], r["max"], r["count"]) == (own.min(), own.max(), len(own))
