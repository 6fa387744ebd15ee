"""Labelled examples from records, files and SQL tables.

An example is a row with a key, a prompt and any number of label, case and metadata columns. Readers are lazy: columns
that a query does not use are not read, and filters reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import fill_template

#: Parts of a list that is joined with every row of another one.
_DEALT = 16

#: Rows of a sample for each range that is to be found, and rows of a range, at least.
_SAMPLED, _LEAST = 40, 2000

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def examples(
    records: DataFrame,
    key: str,
    prompt: str | None = "prompt",
    template: str | None = None,
    labels: Sequence[str] = (),
    cases: Sequence[str] = (),
    metadata: Sequence[str] = (),
) -> DataFrame:
    """example_key, prompt, and the chosen columns prefixed label_, case_ and meta_.

    The key is a string. A chosen column that records lack is null. With a template, its placeholders are columns of
    records; one that is missing raises KeyError. Case values are strings; a null case stays null.
    """
    have = set(records.columns)
    column = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    text = fill_template(template, {c: F.col(f"`{c}`") for c in records.columns}) if template else column(prompt)
    return records.select(
        F.col(f"`{key}`").cast("string").alias("example_key"),
        text.alias("prompt"),
        *(column(c).alias(f"label_{c}") for c in labels),
        *(column(c).cast("string").alias(f"case_{c}") for c in cases),
        *(column(c).alias(f"meta_{c}") for c in metadata),
    )


def repeated_keys(rows: DataFrame, key: str = "example_key") -> DataFrame:
    """(key, count) of the keys that several rows have; empty for a valid set of examples."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).where("count > 1")


def read_file(spark: SparkSession, path: str, place: Sequence[str] = ()) -> DataFrame:
    """Records of a .json (a list, or an object with the list `examples`), .jsonl or .parquet file or folder.

    place names two more columns: the file that a record is in, and where the split of the file begins that it was read with.
    """
    at = [F.col(f"_metadata.{field}").alias(name) for field, name in zip(("file_path", "file_block_start"), place)]
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("*", *at)
    if path.endswith(".jsonl"):
        return spark.read.option("mode", "FAILFAST").json(path).select("*", *at)
    if path.endswith(".json"):
        whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        if whole.columns != ["examples"]:
            return whole.select("*", *at)
        return whole.select(F.explode("examples").alias("e"), *at).select("e.*", *place)
    raise ValueError(f"no reader for {path}: .json, .jsonl or .parquet")


def read_packs(
    spark: SparkSession, packs: Mapping[str, str], limit_per_file: int | None = None, order: str | None = None,
    given: Mapping[str, Mapping[str, str]] | None = None, limit: int | None = None,
) -> DataFrame:
    """JSON files by source name, with the columns source, row and example_key ({source}_{row:06d}, counted per file).

    Rows are counted in the order of the column `order`, or that of the file: by the place of the split and the row in it,
    which are the same in every read. given has, by source, columns of fixed text, such as labels, which replace those of the file. limit is the number of rows
    of all files, taken in the order of the packs and of their rows.
    """
    parts, columns = [], list(dict.fromkeys(c for named in (given or {}).values() for c in named))
    for at, (source, path) in enumerate(packs.items()):
        records = read_file(spark, path, ["_file", "_split"]).withColumn("_at", F.monotonically_increasing_id())
        part = number_rows(records, [*([order] if order else []), "_file", "_split", "_at"], "row").withColumn("source", F.lit(source))
        named = (given or {}).get(source, {})
        part = part.withColumns({c: F.lit(named[c]) if c in named else F.col(c) if c in part.columns else F.lit(None).cast("string") for c in columns} | {"_pack": F.lit(at)})
        parts.append((part.where(F.col("row") < limit_per_file) if limit_per_file else part).drop("_at", "_file", "_split"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    if limit is not None:
        whole = whole.orderBy("_pack", "row").limit(limit)
    return whole.drop("_pack").withColumn("example_key", F.format_string("%s_%06d", "source", "row"))


def read_table(spark: SparkSession, url: str, table: str | None = None, sql: str | None = None, properties: Mapping[str, str] | None = None, **partitioning) -> DataFrame:
    """A table or query of a JDBC database; filters and columns are pushed down, keys split the read if given.

    Exactly one of table and sql. A table's name must be an identifier, with dots between parts. partitioning is
    Spark's partitionColumn, lowerBound, upperBound and numPartitions.
    """
    if (table is None) == (sql is None):
        raise ValueError("give either table or sql")
    if table is not None and not _IDENTIFIER.fullmatch(table):
        raise ValueError(f"{table!r} is no table name")
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}), **{k: str(v) for k, v in partitioning.items()})
    return reader.option("dbtable", table if table else f"({sql}) src").load()


def index_keys(records: DataFrame, prefix: str, order: Sequence[str], key: str | None = None) -> DataFrame:
    """example_key: the column key, or {prefix}_{row:06d} where it is null, rows counted from 0 in the given order.

    The global count is a range partitioning and a running sum of partition sizes, not one task with all rows.
    """
    ranked = number_rows(records, order)
    fill = F.format_string("%s_%06d", F.lit(prefix), "ord")
    return ranked.withColumn("example_key", F.coalesce(F.col(key).cast("string"), fill) if key else fill)


def _literal(value, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def range_part(rows: DataFrame, order: Sequence[str], parts: int | None = None) -> Column:
    """The number, from 0, of the range of the order columns that a row lies in; about `parts` ranges with as many rows each, fewer for few rows.

    Bounds are taken once, from a sample that is counted and bounded, and are literals of the expression. So a row has one
    range wherever the expression is used, rows that are equal in the order columns share it, and whatever the sample,
    every row has one: only how even the ranges are depends on it.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*order)
    total = keys.count()
    parts = min(parts, total // _LEAST)
    if parts < 2:
        return F.lit(0)
    sample = keys.sample(min(1.0, _SAMPLED * parts / total), seed=17).orderBy(*order).collect()
    bounds = list(dict.fromkeys(tuple(sample[i * len(sample) // parts]) for i in range(1, parts))) if sample else []
    if not bounds:
        return F.lit(0)
    key = F.struct(*order)
    one = lambda bound: _literal(bound, keys.schema)
    wide = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]  # looked up in two steps
    below = lambda listed: F.size(F.filter(listed, lambda b: b < key))
    block = below(F.array(*[one(b[-1]) for b in blocks]))
    within = F.get(F.array(*[F.array(*map(one, b)) for b in blocks]), block)
    return (block * wide + F.coalesce(F.when(within.isNotNull(), below(within)), F.lit(0))).cast("int")


def number_rows(rows: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """rows with their number from 0 in a total order; rows equal in it are numbered in any order.

    Rows are dealt into ranges and numbered within them; the sizes of the ranges, one row for each, give the rest.
    """
    part = range_part(rows, order)
    sizes = {r["part"]: r["size"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}
    starts, before = [], 0
    for i in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(i, 0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1
    start = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("_part"))
    return rows.withColumn("_part", part).withColumn(name, within + start).drop("_part")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None, name: str = "rank") -> DataFrame:
    """rows with the number of rows (or the sum of `weight`) before each in its group, in a total order.

    Rows are dealt into ranges of keys and order, so that a group may lie in many tasks; the totals of each range and
    group, one row each, give the rest. A null key is a group too.
    """
    keys = list(keys)
    dealt = rows.withColumn("_part", range_part(rows, [*keys, *order]))
    value = F.col(weight) if weight else F.lit(1)
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sizes = dealt.groupBy("_part", *keys).agg(F.sum(value).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    starts = sizes.select(F.col("_part").alias("_of"), *[F.col(k).alias(n) for k, n in named.items()], F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_of")
    for k, n in named.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    return local.join(starts, same).withColumn(name, F.col("_before") + F.col("_start")).drop("_part", "_before", "_start", "_of", *named.values())


def page(rows: DataFrame, order: Sequence[str], size: int, number: int) -> DataFrame:
    """The rows of one page in a total order."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def explode_records(rows: DataFrame, column: str, index: str = "index", fields: Mapping[str, Sequence[str]] | None = None, schema: str | None = None) -> DataFrame:
    """A row for each element of an array column, or of a JSON list given as text with its schema; a null gives none.

    fields maps new columns to paths in the element, of which the first that is not null counts.
    """
    items = F.from_json(column, schema) if schema else F.col(column)
    out = rows.select("*", F.posexplode(items).alias(index, "_item"))
    for name, paths in (fields or {}).items():
        out = out.withColumn(name, F.coalesce(*[F.col(f"_item.{p}") for p in paths]))
    return out.drop("_item")


def list_contrast(rows: DataFrame, key: Column, positive: Column, negative: Column, sides=("positive", "negative")) -> DataFrame:
    """A row for each item of two lists, split at semicolons and trimmed: example_key ({key}_{side}_{i:03d}), side, item."""
    parts = []
    for side, items in zip(sides, (positive, negative)):
        trimmed = F.filter(F.transform(F.split(items, ";"), lambda x: F.trim(x)), lambda x: x != "")
        part = rows.select(key.alias("_key"), F.lit(side).alias("side"), F.posexplode(trimmed).alias("_i", "item"))
        parts.append(part.select(F.format_string("%s_%s_%03d", "_key", "side", "_i").alias("example_key"), "side", "item"))
    return parts[0].unionByName(parts[1])


def expand_prompts(instructions: DataFrame, questions: DataFrame, model_name: str) -> DataFrame:
    """Every instruction (instruction_id, instruction) with every question (question_id, question).

    {model_name} in an instruction is replaced. Questions are dealt in parts, and each instruction is joined with every
    part, so that the product is spread over tasks.
    """
    filled = instructions.withColumn("instruction", F.replace("instruction", F.lit("{model_name}"), F.lit(model_name)))
    dealt = questions.select("question_id", "question", F.pmod(F.xxhash64("question_id"), F.lit(_DEALT)).alias("_part"))
    each = filled.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALT - 1).cast("long"))))
    rows = each.join(dealt, "_part").select("instruction_id", "instruction", "question_id", "question")
    return rows.withColumn("example_key", F.format_string("i%03d_q%03d", F.col("instruction_id").cast("int"), F.col("question_id").cast("int")))
