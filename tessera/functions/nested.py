"""Values of any shape: canonical JSON and hashes of them, records and fields of nested JSON by path."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import json_list, json_string

#: The keys of an object under which its records may be, in the order they are looked up.
RECORD_KEYS = ("criteria", "criterion", "rubric", "items", "annotations")

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain(kind: T.DataType) -> bool:
    """Whether canonical JSON of the type is built from column functions: strings, whole numbers, booleans and nests of these."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _plain(kind.valueType)
    return isinstance(kind, (T.StringType, T.BooleanType, *_WHOLE))


def _built(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), _built(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = json_list(F.transform(value, lambda x: _built(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))  # keys differ, so values are not compared
        entries = entries if _sortable(kind.valueType) else F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        listed = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), _built(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(F.coalesce(text, F.lit("null")))


def _sortable(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return not isinstance(kind, T.MapType) and all(map(_sortable, inner))


def canonical_text(text: Column) -> Column:
    """A JSON text in canonical form: keys sorted, no white space, ASCII, numbers as short as they can be; null for null. Of a key that comes twice, the last value counts."""

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")))

    return written(text)


def canonical_json(rows: DataFrame, column: str) -> Column:
    """The values of a column of any type as canonical JSON; null is the text null.

    Strings, whole numbers, booleans and their lists, maps and structs are written by column functions. Types with other numbers, and VARIANT, are
    written as JSON, which batches of a Python worker bring into canonical form.
    """
    kind, value = rows.schema[column].dataType, F.col(f"`{column}`")
    if _plain(kind):
        return _built(value, kind)
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    whole = canonical_text(text)  # {"v":...}
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def stable_hash(rows: DataFrame, column: str) -> Column:
    """SHA-256 of the canonical JSON of a column."""
    return F.sha2(canonical_json(rows, column), 256)


def hash_columns(rows: DataFrame, hashes: Mapping[str, str | Sequence[str]], digits: int = 24) -> DataFrame:
    """rows with, for each new name, the first digits of the hash of the object of the given columns.

    A column that is not there is an error; a null is hashed as null.
    """
    for name, sources in hashes.items():
        sources = [sources] if isinstance(sources, str) else list(sources)
        lacking = [c for c in sources if c not in rows.columns]
        if lacking or not sources:
            raise KeyError(f"{name}: no columns {lacking}")
        whole = rows.withColumn("_object", F.struct(*[F.col(f"`{c}`").alias(c) for c in sources]))
        rows = whole.withColumn(name, F.substring(stable_hash(whole, "_object"), 1, digits)).drop("_object")
    return rows


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _named(part: str):
    return lambda key, _: F.lower(key) == part.lower()


def path_value(value: Column, paths: str | Sequence[str]) -> Column:
    """The first value of a VARIANT that one of the dotted paths leads to and that is not null.

    A key that is not there as it is written is looked up without regard to case; of several such, the last counts.
    """
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        at = value
        for part in filter(None, path.split(".")):
            keys = F.try_variant_get(F.when(_is_object(at), at), "$", "map<string,variant>")
            alike = F.map_values(F.map_filter(keys, _named(part)))
            at = F.when(F.map_contains_key(keys, part), F.try_element_at(keys, F.lit(part))).otherwise(F.try_element_at(alike, F.lit(-1)))
        found.append(F.when(~F.is_variant_null(at), at))
    if not found:
        raise ValueError("no paths")
    return F.coalesce(*found)


def literal_json(text: Column) -> Column:
    """JSON of a text that is a literal of Python, such as {'a': None}; an error if it is none. null stays null."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(ast.literal_eval(t)))

    return read(text)


def nested_records(rows: DataFrame, column: str) -> Column:
    """array<variant>: the records of a column of JSON text (or Python literals), VARIANT, or any nested type.

    A list is its records. Of an object, those under the first of RECORD_KEYS that has a list; else its values, if all are objects: those of
    a text in its order, of a VARIANT in that of the keys. Null and blank texts have none. All else, and a record that is no object, is an error.
    """
    kind, value = rows.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        text = F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))
        text = F.when(text != "", text)
        literal = literal_json(F.when(F.try_parse_json(text).isNull(), text))  # other rows are passed as null
        text = F.coalesce(literal, text)
        whole = F.try_parse_json(text)
        fields = F.map_values(F.from_json(F.when(_is_object(whole), text), "map<string,variant>"))
    else:
        whole = value if isinstance(kind, T.VariantType) else F.to_variant_object(value)
        fields = F.map_values(F.try_variant_get(F.when(_is_object(whole), whole), "$", "map<string,variant>"))
    under = [F.try_variant_get(whole, f"$.{k}", "array<variant>") for k in RECORD_KEYS]
    listed = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
    of_values = F.when((F.size(fields) > 0) & F.forall(fields, _is_object), fields)
    records = F.when(_is_object(whole), F.coalesce(*under, of_values)).otherwise(listed)
    wrong = (whole.isNotNull() & ~F.is_variant_null(whole) & records.isNull()) | (records.isNotNull() & ~F.forall(records, _is_object))
    return F.when(wrong, F.raise_error(F.concat(F.lit("nested records must be a list of objects: "), F.substring(F.to_json(whole), 1, 80)))).otherwise(records)


def explode_nested(rows: DataFrame, column: str, fields: Mapping[str, str | Sequence[str]], index: str | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each nested record of a column, with new columns by paths (see nested_records() and path_value()).

    index names a column of the record's place. Fields are strings unless `types` has another SQL type; variant keeps the value as it is. New
    columns replace others of their name. Rows without records give none.
    """
    types = types or {}
    out = rows.withColumn("_records", nested_records(rows, column)).select("*", F.posexplode("_records").alias("_place", "_record"))
    made = {}
    for name, paths in fields.items():
        found = path_value(F.col("_record"), paths)
        kind = types.get(name, "string")
        made[name] = found if kind == "variant" else F.try_variant_get(found, "$", kind)
    if index:
        made[index] = F.col("_place")
    return out.withColumns(made).drop("_records", "_record", "_place")
