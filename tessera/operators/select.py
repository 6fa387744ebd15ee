"""Selection, alignment and checks of keyed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_label(rows: DataFrame, label: str, value) -> DataFrame:
    """Rows whose label equals the value; a null label equals nothing."""
    return rows.where(F.col(label) == F.lit(value))


def select_rows(rows: DataFrame, key: str, keys: DataFrame | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows with a key in keys (one column), then the first `limit` of them in a total order."""
    if keys is not None:
        rows = rows.join(keys.toDF(key).distinct(), key, "left_semi")
    return rows if limit is None else rows.orderBy(*(order or [key])).limit(limit)


def missing_keys(base: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys of wanted that base lacks."""
    return wanted.select(key).distinct().join(base.select(key), key, "left_anti")


def align(base: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of base with a key of wanted; ValueError, with a sample, if base lacks some or none are wanted."""
    lacking = [r[0] for r in missing_keys(base, wanted, key).limit(5).collect()]
    if lacking:
        raise ValueError(f"keys without a row, such as {lacking}")
    if wanted.isEmpty():
        raise ValueError("no rows are wanted")
    return base.join(wanted.select(key).distinct(), key, "left_semi")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order: partial aggregation, not a window over whole groups."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def cap_groups(rows: DataFrame, group: str, order: Sequence[Column], cap: int) -> DataFrame:
    """At most `cap` rows of each group, the first in a total order, with their rank from 1."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap)  # limited within partitions before the shuffle


def map_label(rows: DataFrame, label: str, mapping: Mapping[str, str], default: str | None = None, name: str = "mapped", strict: bool = False) -> DataFrame:
    """The label, as text, looked up in the mapping; without an entry, the default. A null label is the text "None".

    With strict, a label without an entry is an error instead.
    """
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map().cast("map<string,string>")
    text = F.coalesce(F.col(label).cast("string"), F.lit("None"))
    other = F.raise_error(F.concat(F.lit(f"{label} has no entry for "), text)) if strict else F.lit(default)
    return rows.withColumn(name, F.coalesce(F.try_element_at(table, text), other))


def label_fields(rows: DataFrame, column: str, fields: Mapping[str, str], strict: bool = False) -> DataFrame:
    """New text columns from the top-level fields of a JSON object given as text; null where they are absent.

    With strict, an absent field is an error instead; a null one stays null.
    """
    if not strict:
        return rows.withColumns({name: F.get_json_object(column, f"$.{field}") for name, field in fields.items()})
    keys = F.json_object_keys(column)
    absent = lambda f: ~F.coalesce(F.array_contains(keys, f), F.lit(False))
    value = lambda f: F.when(absent(f), F.raise_error(F.lit(f"{column} has no field {f}"))).otherwise(F.get_json_object(column, f"$.{f}"))
    return rows.withColumns({name: value(field) for name, field in fields.items()})


def sections_where(records: DataFrame, column: str, names: Sequence[str] = (), **wanted: str) -> DataFrame:
    """Section records of an array column with one of the names and the wanted fields, a field being looked up in the
    record and then in its map of tags. They are ordered by index, then first position, then name."""
    fields = {f.name for f in records.schema[column].dataType.elementType.fields}

    def keep(r: Column) -> Column:
        value = lambda f: r[f] if f in fields else r["tags"][f]
        tests = [r["name"].isin(*names)] if names else []
        return F.coalesce(_all([*tests, *(value(f) == F.lit(v) for f, v in wanted.items())]), F.lit(False))

    def rank(r: Column) -> Column:
        at = F.array_min(r["token_positions"])
        known = r["index"].isNotNull()
        group = F.when(known, 0).when(at.isNotNull(), 1).otherwise(2)
        return F.struct(group.alias("g"), F.when(known, r["index"]).otherwise(F.coalesce(at, F.lit(0))).alias("i"), r["name"].alias("n"), r.alias("r"))

    chosen = F.transform(F.filter(column, keep), rank)
    return records.withColumn(column, F.transform(F.array_sort(chosen, lambda a, b: _compare(a, b)), lambda x: x["r"]))


def _compare(a: Column, b: Column) -> Column:
    order = lambda f: F.when(a[f] < b[f], -1).when(a[f] > b[f], 1)
    return F.coalesce(order("g"), order("i"), order("n"), F.lit(0))


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def text_filter(rows: DataFrame, text: str, min_chars: int, among: Mapping[str, Sequence], test: Column | None = None) -> DataFrame:
    """Rows whose text has min_chars characters or more, with the columns of `among` in their lists and the test true."""
    tests = [F.length(text) >= min_chars, *(F.col(c).isin(*values) for c, values in among.items())]
    return rows.where(_all(tests if test is None else [*tests, test]))


def scored_roles(rows: DataFrame, role: str, default: str, score: str, values: Sequence[str]) -> DataFrame:
    """Rows of roles other than the default whose score, as text, is one of the values."""
    return rows.where((F.col(role) != default) & F.col(score).isin(*values))


def coerced_sections(given: Column) -> Column:
    """Section records (name, index, token_positions) from a JSON list: section_name and positions are other names of the
    first and the last; records without positions go."""
    schema = "array<struct<name:string,section_name:string,index:int,token_positions:array<int>,positions:array<int>>>"
    of = lambda s: F.struct(F.coalesce(s["name"], s["section_name"]).alias("name"), s["index"].alias("index"), F.coalesce(s["token_positions"], s["positions"]).alias("token_positions"))
    return F.filter(F.transform(F.from_json(given, schema), of), lambda s: F.coalesce(F.size(s["token_positions"]) > 0, F.lit(False)))
