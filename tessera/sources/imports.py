"""Imports of coordinates, vector spaces and probes from JSON files, label lookups, and report and catalog files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import norm, unit


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_coordinates(spark: SparkSession, path: str, name: str, layer: int | None = None) -> DataFrame:
    """(coordinate, layer, vector, raw_vector, norm) of a JSON file with a vector, a list of them, one for each layer, or an
    object with either as "axis". vector has length 1; `layer` picks one row of a list."""
    text = F.coalesce(F.get_json_object("value", "$.axis"), F.col("value"))
    many = F.from_json(text, "array<array<double>>")
    one = F.from_json(text, "array<double>")
    rank = F.when(F.regexp_like(text, F.lit(r"^\s*\[\s*\[")), many).otherwise(F.array(one))
    rows = _whole(spark, path).select(F.posexplode(rank).alias("layer", "raw_vector"))
    rows = rows if layer is None else rows.where(F.col("layer") == layer)
    return rows.select(F.lit(name).alias("coordinate"), "layer", unit(F.col("raw_vector")).alias("vector"), "raw_vector", norm(F.col("raw_vector")).alias("norm"))


def read_vector_space(spark: SparkSession, path: str) -> DataFrame:
    """(layer, concept, vector) of a JSON object {layer: {concept: vector}}, or one with that as "layers"."""
    text = F.coalesce(F.get_json_object("value", "$.layers"), F.col("value"))
    layers = _whole(spark, path).select(F.explode(F.from_json(text, "map<string,map<string,array<double>>>")).alias("layer", "_c"))
    return layers.select(F.col("layer").cast("int").alias("layer"), F.explode("_c").alias("concept", "vector"))


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """One row: classes, coef (rows), intercept, mean, scale, threshold of a stored probe.

    ValueError for fewer than two classes, coefficients that are no matrix, or other lengths of mean and scale.
    """
    schema = "classes array<string>, coef array<array<double>>, intercept array<double>, mean array<double>, scale array<double>, threshold double"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    size = F.size(F.get("coef", F.lit(0)))
    fits = (F.size("classes") >= 2) & (F.size("coef") >= 1) & (F.size("coef") == F.size("intercept"))
    good = fits & (F.size("mean") == size) & (F.size("scale") == size) & F.forall("coef", lambda c: F.size(c) == size)
    if rows.where(~F.coalesce(good, F.lit(False))).limit(1).count() or rows.isEmpty():
        raise ValueError(f"{path} is no probe")
    return rows


def label_values(records: DataFrame, key: str, label: str) -> DataFrame:
    """example_key and one label: a scan that reads no other column."""
    return records.select(F.col(key).cast("string").alias("example_key"), F.col(label).alias("value"))


def merged_metadata(built: Column, explicit: Column) -> Column:
    """The entries of both maps; an explicit one goes before one that was built. A null map has no entries."""
    empty = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce(built, empty), lambda k, _: ~F.map_contains_key(F.coalesce(explicit, empty), k))
    return F.map_concat(rest, F.coalesce(explicit, empty))


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON lines in a folder of its own, in one file."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, schema: str, wanted: Mapping[str, object] | None = None) -> DataFrame:
    """Records of a folder of JSON files, a record each, with the wanted values."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    for column, value in (wanted or {}).items():
        rows = rows if value is None else rows.where(F.col(column) == F.lit(value))
    return rows
