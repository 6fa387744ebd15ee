"""Tables of databases, read in parallel: by shards of a hash, and page by page in the order of a key."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import hash_shard

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Pages whose bounds are looked up at most; each is one small query of the driver.
MOST_PAGES = 100_000


def identifier(name: str) -> str:
    """A column's name in quotes; ValueError for what is no plain identifier."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"{name!r} is no identifier")
    return f'"{name}"'


def relation(name: str) -> str:
    """A table's name in quotes, part by part."""
    return ".".join(map(identifier, name.split(".")))


def literal(value) -> str:
    """A value as a literal of SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("no literal for a number that is not finite")
        return repr(value)
    text = str(value)
    if "\x00" in text:
        raise ValueError("no literal for a text with a zero character")
    return "'" + text.replace("'", "''") + "'"


def _source(table: str | None, sql: str | None) -> str:
    if (table is None) == (sql is None):
        raise ValueError("give either table or sql")
    if table is not None:
        return relation(table)
    query = sql.strip().removesuffix(";").rstrip()
    if not query:
        raise ValueError("the query is empty")
    return f"({query})"


def select_sql(columns: Sequence[str], table: str | None = None, sql: str | None = None, where: Sequence[str] = (), order: str | None = None, limit: int | None = None) -> str:
    """A query of the named columns, each once."""
    listed = ", ".join(identifier(c) for c in dict.fromkeys(columns)) or "*"
    parts = [f"SELECT {listed} FROM {_source(table, sql)} src"]
    parts += ["WHERE " + " AND ".join(where)] if where else []
    parts += [f"ORDER BY {identifier(order)}"] if order else []
    parts += [f"FETCH FIRST {int(limit)} ROWS ONLY"] if limit is not None else []
    return " ".join(parts)


def _reader(spark: SparkSession, url: str, properties: Mapping[str, str] | None):
    return spark.read.format("jdbc").option("url", url).options(**(properties or {}))


def _postgres_shard(column: str, shards: int) -> str:
    """The shard of a hash in hex by its first 16 digits, as functions.text.hash_shard() has it.

    The two halves of the digits are taken modulo the shards one after the other, so that whole numbers of 64 bits do.
    """
    half = lambda at: f"CAST(CAST('x' || substr({identifier(column)}, {at}, 8) AS bit(32)) AS bigint)"
    n = int(shards)
    return f"({half(1)} % {n} * {2**32 % n} + {half(9)}) % {n}"


def read_columns(
    spark: SparkSession, url: str, columns: Sequence[str], table: str | None = None, sql: str | None = None,
    limit: int | None = None, shard: tuple[str, int, int] | None = None, properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """The columns of a table or a query, `limit` rows at most.

    shard is (column of a hash in hex, shards, which of them, from 0): PostgreSQL gets it as a condition, of other databases the rows are read and those of the
    shard kept, after the limit has been applied to nothing but the shard's rows.
    """
    if shard is not None and not 0 <= shard[2] < max(1, shard[1]):
        raise ValueError(f"shard {shard[2]} of {shard[1]}")
    own = shard is not None and shard[1] > 1
    pushed = own and url.startswith("jdbc:postgresql:")
    where = [f"{_postgres_shard(shard[0], shard[1])} = {int(shard[2])}"] if pushed else []
    wanted = [*columns, *([shard[0]] if own and not pushed else [])]
    query = select_sql(wanted, table, sql, where, limit=limit if pushed or not own else None)
    rows = _reader(spark, url, properties).option("dbtable", f"({query}) page").load()
    if own and not pushed:
        rows = rows.where(hash_shard(F.col(shard[0]), shard[1]) == shard[2])
        rows = rows if limit is None else rows.limit(limit)
    return rows.select(*dict.fromkeys(columns))


def read_shards(spark: SparkSession, url: str, columns: Sequence[str], hash_column: str, shards: int, table: str | None = None, sql: str | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of a PostgreSQL table, a partition for each shard of a hash in hex, each read by a query of its own; rows without a hash come with the first."""
    where = [f"{_postgres_shard(hash_column, shards)} = {i}" for i in range(shards)]
    where[0] = f"({where[0]} OR {identifier(hash_column)} IS NULL)"
    query = select_sql([*columns, hash_column], table, sql)
    return spark.read.jdbc(url, f"({query}) page", predicates=where, properties=dict(properties or {})).select(*dict.fromkeys(columns))


def page_bounds(spark: SparkSession, url: str, key: str, size: int, table: str | None = None, sql: str | None = None, properties: Mapping[str, str] | None = None) -> list:
    """The last key of each page of `size` rows in the order of a unique key, up to the page that is short.

    Each is a small query that goes on after the key before it, so that the database passes over no rows twice.
    """
    bounds, last = [], None
    while len(bounds) < MOST_PAGES:
        where = [f"{identifier(key)} IS NOT NULL"] + ([f"{identifier(key)} > {literal(last)}"] if last is not None else [])
        page = select_sql([key], table, sql, where, key, size)
        found = _reader(spark, url, properties).option("dbtable", f"(SELECT MAX({identifier(key)}) AS k, COUNT(*) AS n FROM ({page}) keys) page").load().first()
        if found is None or not found[1]:
            return bounds
        last = found[0]
        bounds.append(last)
        if found[1] < size:
            return bounds
    raise ValueError(f"more than {MOST_PAGES} pages")


def read_pages(spark: SparkSession, url: str, columns: Sequence[str], key: str, size: int, table: str | None = None, sql: str | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of a table or query, a partition for each page of `size` rows in the order of a unique key; rows without a key come last.

    Keys are numbers or texts. Rows that are added behind the last page while it is read come with it.
    """
    if size < 1:
        raise ValueError("a page has one row or more")
    k, bounds = identifier(key), page_bounds(spark, url, key, size, table, sql, properties)
    where = [f"{k} > {literal(a)} AND {k} <= {literal(b)}" for a, b in zip(bounds, bounds[1:-1])]
    if len(bounds) > 1:
        where = [f"{k} <= {literal(bounds[0])}", *where, f"{k} > {literal(bounds[-2])}", f"{k} IS NULL"]
    else:
        where = [f"{k} IS NOT NULL", f"{k} IS NULL"]
    query = select_sql([*columns, key], table, sql)
    return spark.read.jdbc(url, f"({query}) page", predicates=where, properties=dict(properties or {})).select(*dict.fromkeys(columns))
