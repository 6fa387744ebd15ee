"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of UTF-8 bytes. The distinct blocks are sorted and numbered; a block's
number is its name. Adjacent names are then paired, the distinct pairs are numbered in the same way, and so on until
each document has one name left. Two documents have the same (level, name) exactly when their texts are identical:
names come from a comparison of contents, never from a hash alone.

Blocks travel by a 64-bit hash. Where two different blocks share one, their contents decide (`_clashing`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

BLOCK_BYTES = 4096


def _blocks(text: Column, block_bytes: int) -> Column:
    """The text's UTF-8 bytes in blocks; an empty text has one empty block."""
    data = F.encode(text, "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.length(data) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Number distinct rows in the order of keys within the partitions they were dealt to."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _clashing(names: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(hash, block, name) of the blocks that share their hash with another block; None if there are none."""
    shared = scratch.write(names.groupBy("hash").count().where("count > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return None
    distinct = blocks.join(shared, "hash", "left_semi").groupBy("hash", "block").agg(F.count("*").alias("n"))
    named = _numbered(distinct.select("hash", "block"), "block").withColumn("name", -1 - F.col("name"))
    return scratch.write(named, "clashing")


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hasher: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Return (row, id_col, text_sha256, level, name): one row for each row of docs, where row numbers the rows.

    Equal (level, name) means equal text. A null text is read as empty. A null or repeated id_col is kept as it is;
    rows are told apart by `row`, their number in the scan. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    hashes = F.transform(_blocks(F.col("text"), block_bytes), lambda b: hasher(b))
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2("text", 256).alias("sha"), hashes.alias("hashes"))
    keyed = scratch.write(keyed, "keyed")
    blocks = rows.select(F.explode_outer(_blocks(F.col("text"), block_bytes)).alias("block")).select(hasher(F.col("block")).alias("hash"), "block")
    distinct = blocks.groupBy("hash", "block").agg(F.count("*").alias("n"))
    names = scratch.write(_numbered(distinct, "block").select("hash", "name"), "names")

    tokens = keyed.select("row", F.posexplode_outer("hashes").alias("pos", "hash"))
    clashing = _clashing(names, blocks, scratch)
    if clashing is None:
        named = tokens.join(names, "hash").select("row", "pos", "name")
    else:
        # Rows are read again with their texts, so that their numbers must be written beside these.
        rows = scratch.numbered(rows, "row")
        keyed = rows.select("row", "id", F.sha2("text", 256).alias("sha"), hashes.alias("hashes"))
        tokens = keyed.select("row", F.posexplode_outer("hashes").alias("pos", "hash"))
        named = _with_clashes(rows, tokens, names, clashing, block_bytes, hasher)
    named = scratch.write(named.select("row", "pos", "name"), "level")

    done, level = None, 0
    while True:
        last = named.agg(F.max("pos")).first()[0] or 0
        if last:
            # A document whose only name is at position 0 is finished; the others go on in pairs.
            many = named.where("pos = 1").select("row")
            ended = named.where("pos = 0").join(many, "row", "left_anti")
        else:
            ended = named
        ended = ended.select("row", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if not last:
            break
        pairs = (
            named.join(many, "row", "left_semi")
            .groupBy("row", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.min_by("name", "pos").alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"))
        )
        pairs = scratch.write(pairs, "pairs")
        numbers = _numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("n")), "left", "right").select("left", "right", "name")
        joined = pairs.alias("p").join(numbers.alias("q"), F.expr("p.left = q.left and p.right <=> q.right"))
        named, level = scratch.write(joined.select("row", "pos", "name"), "level"), level + 1
    return keyed.join(done, "row").select("row", F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), "level", "name")


def _with_clashes(rows: DataFrame, tokens: DataFrame, names: DataFrame, clashing: DataFrame, block_bytes: int, hasher) -> DataFrame:
    """Names by hash where the hash has one block, else by the block itself."""
    shared = clashing.select("hash").distinct()
    plain = tokens.join(names.join(shared, "hash", "left_anti"), "hash").select("row", "pos", "name")
    whole = rows.select("row", F.posexplode_outer(_blocks(F.col("text"), block_bytes)).alias("pos", "block"))
    whole = whole.withColumn("hash", hasher(F.col("block"))).join(clashing, ["hash", "block"])
    return plain.unionByName(whole.select("row", "pos", "name"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id_col stays (of several such rows, one). A null id_col is smaller than
    any other; keep_id is null where all ids of a group are. A null text equals an empty one. An empty table gives no
    rows. Columns of docs other than the two named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = scratch.write(name_documents(docs, id_col, text_col, block_bytes), "named")
    best = F.max(F.struct(F.col(id_col).alias("id"), F.col("row").alias("row")))
    groups = named.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    # Written, so that both sides of the join are dealt anew and it can split a group that holds many of all rows.
    groups = scratch.write(groups, "groups")
    return named.join(groups, ["level", "name"]).select(
        id_col,
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
