"""Expert routing records of a token: dense vectors, top-k weights and loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles, softmax, top_k, total


def dense_top_k(ids: Column, weights: Column, experts: int) -> Column:
    """Weights at their experts' places, 0 elsewhere; an expert named several times has its last weight."""
    given = F.coalesce(weights, F.transform(ids, lambda _: F.lit(1.0)))
    pairs = F.zip_with(ids, given, lambda i, w: F.struct(i.alias("i"), w.alias("w")))
    at = lambda e: F.element_at(F.filter(pairs, lambda p: p["i"] == e), -1)["w"]
    has = lambda e: F.exists(ids, lambda i: i == e)
    return F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda e: F.when(has(e), at(e)).otherwise(F.lit(0.0)))


def dense_load(load: Column, experts: int) -> Column:
    """Counts of a map at their experts' places, 0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda e: F.coalesce(F.try_element_at(load, e), F.lit(0)).cast("double"))


def routing_vector(logits: Column, probabilities: Column, ids: Column, weights: Column, load: Column, experts: int) -> Column:
    """The first that is given of gate logits, gate probabilities, top-k weights and loads."""
    return F.coalesce(doubles(logits), doubles(probabilities), F.when(ids.isNotNull(), dense_top_k(ids, weights, experts)), F.when(load.isNotNull(), dense_load(load, experts)))


def normalized_weights(values: Column) -> Column:
    """Differences to the least value plus a millionth, over their sum."""
    shifted = F.transform(values, lambda v: v - F.array_min(values) + 1e-6)
    return F.transform(shifted, lambda v: v / total(shifted))


def derive(rows: DataFrame, logits: str, k: int) -> DataFrame:
    """rows with probabilities, the k experts of the greatest logits and their normalized weights."""
    chosen = rows.withColumn("probabilities", softmax(doubles(logits))).withColumn("_top", top_k(doubles(logits), k))
    ids, values = F.transform("_top", lambda t: t["index"]), F.transform("_top", lambda t: t["value"])
    return chosen.withColumn("expert_ids", ids).withColumn("expert_weights", normalized_weights(values)).drop("_top")


def expert_load(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expert, tokens: how often each expert was chosen."""
    return rows.select(*keys, F.explode("expert_ids").alias("expert")).groupBy(*keys, "expert").agg(F.count("*").alias("tokens"))
