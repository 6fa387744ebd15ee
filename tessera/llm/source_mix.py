"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output over the rows it has. Each row's count is the Poisson
quantile of a uniform number that a hash of its id and the seed gives, so it is the same in every run and in any
partitioning, and the expected rows of a source are exactly its target. Rows are exploded by their counts and put in
a global order by a hash of id, replica and seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Below this many sources their table is broadcast; beyond it, it is joined by shuffling salted keys.
BROADCAST_SOURCES = 10_000
_SALTS = 64
#: Where a source's rate is higher, rows are repeated by so many copies at a time.
SPLIT = 1000
#: Beyond this rate exp(-rate) is no longer a normal double, and cumulative probabilities begin nearer to the mode.
_PLAIN_RATE = 700.0


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined with colons; null is written \\N."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string"), F.lit("\\N")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _first_count(rate: Column) -> Column:
    """The count at which _quantiles() begins: less than it is less probable than a double's precision."""
    return F.when(rate <= _PLAIN_RATE, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 24).cast("int"))


def _quantiles(rate: Column) -> Column:
    """Cumulative Poisson probabilities from _first_count() on; long enough that the rest is below a double's precision.

    Beyond _PLAIN_RATE they are summed up from 1 for the first count, and divided by their total.
    """
    first, last = _first_count(rate), F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    p = F.when(rate <= _PLAIN_RATE, F.exp(-rate)).otherwise(F.lit(1.0))
    start = F.struct(p.alias("p"), p.alias("sum"), F.array(p).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    def finish(acc: Column) -> Column:
        return F.when(rate <= _PLAIN_RATE, acc["all"]).otherwise(F.transform(acc["all"], lambda q: q / acc["sum"]))

    return F.aggregate(F.sequence(first + 1, last), start, step, finish)


def mix_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 0.0, total_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """(source, rows, rate): the mean copies of each row of a source.

    Weights are relative; a source without one, null included, has default_weight. They are normalised over the
    sources that have rows. total_rows is the expected output, by default the number of input rows.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    counts = Scratch(docs.sparkSession, "mix-rates").write(counts, "counts")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    given = F.element_at(table, F.col("source")) if weights else F.lit(None)
    weight = F.coalesce(F.when(F.col("source").isNotNull(), given), F.lit(float(default_weight))).cast("double")
    weighted = counts.withColumn("weight", weight)
    sums = weighted.agg(F.sum("weight").alias("weights"), F.sum("rows").alias("rows")).first()
    wanted = F.lit(total_rows if total_rows is not None else sums["rows"] or 0)
    rate = F.coalesce(F.try_divide(F.col("weight") * wanted, F.lit(sums["weights"] or 0.0) * F.col("rows")), F.lit(0.0))
    return weighted.select("source", "rows", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 0.0,
    total_rows: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with each row repeated by its Poisson count, in an order shuffled globally, and the columns replica (from
    0) and shuffle_key; these two replace columns of docs with such names.

    A row's count depends on its id, the seed and its source's rate only: rows of one id and source are repeated
    alike. A null source is a source like another, a null id an id like another. Sources of weight 0 go. An empty
    table, or weights that are all 0, give no rows. Partitions are ranges of shuffle_key, sorted.
    """
    if any(w < 0 or not math.isfinite(w) for w in [*weights.values(), default_weight]):
        raise ValueError("weights must be finite and not negative")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rates = scratch.write(mix_rates(docs, weights, default_weight, total_rows, source_col), "rates").where("rate > 0")
    highest = rates.agg(F.max("rate")).first()[0] or 0.0
    rates = rates.select(F.col("source").alias("_source"), _first_count(F.col("rate")).alias("_first"), _quantiles(F.col("rate")).alias("_quantiles"))
    docs = docs.drop("replica", "shuffle_key")
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("_source")))
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        left = docs.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(_SALTS)).cast("int"))
        joined = left.join(salted.withColumnRenamed("_salt", "_dealt"), F.expr("_salt = _dealt") & F.col(source_col).eqNullSafe(F.col("_source")))
    u = uniform(F.col(id_col), seed)
    copies = F.col("_first") + F.size(F.filter("_quantiles", lambda q: q <= F.col("_u")))
    counted = joined.withColumn("_u", u).withColumn("_copies", copies.cast("int"))
    repeated = counted.where("_copies > 0").withColumn("_start", F.lit(0))
    if highest > SPLIT:  # a few rows may be most of the output: their copies are dealt in pieces before they are made
        pieces = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(SPLIT)))
        repeated = repeated.withColumn("_start", pieces).repartition(F.col(id_col), F.col("_start"))
    last = F.least(F.col("_copies"), F.col("_start") + SPLIT) if highest > SPLIT else F.col("_copies")
    repeated = repeated.withColumn("replica", F.explode(F.sequence(F.col("_start"), last - 1)))
    keyed = repeated.select(*[F.col(f"`{c}`") for c in docs.columns], "replica", uniform(F.col(id_col), F.col("replica"), seed, F.lit("order")).alias("shuffle_key"))
    # Keys are uniform, so their ranges are known beforehand: no sampling pass over the texts.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col("shuffle_key") * parts).cast("int")
    return keyed.repartitionById(parts, part).sortWithinPartitions("shuffle_key", id_col, "replica")


#: The query's weights: the large source is cut to a tenth, two are doubled, one goes, and the rest keep even weights.
QUERY_WEIGHTS = {"src0": 2.0, "src1": 2.0, "src2": 2.0, "src3": 0.0}
QUERY_DEFAULT = 1.0
QUERY_SEED = 7


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, QUERY_WEIGHTS, QUERY_DEFAULT, seed=QUERY_SEED)


SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n,
         CAST(CASE WHEN source IN ('src0', 'src1', 'src2') THEN 2.0 WHEN source = 'src3' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS w
  FROM documents GROUP BY source
),
rates AS (SELECT source, w * (sum(n) OVER ())::BIGINT / ((sum(w) OVER ()) * n) AS rate FROM counts),
quantiles AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS q FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), q + p * rate / (k + 1) FROM quantiles
  WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
),
drawn AS (
  SELECT d.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || ':7'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
),
copies AS (
  SELECT d.doc_id, count(*) AS copies FROM drawn d JOIN quantiles q ON d.source IS NOT DISTINCT FROM q.source AND q.q <= d.u GROUP BY d.doc_id
),
repeated AS (SELECT d.*, unnest(range(c.copies)) AS replica FROM documents d JOIN copies c USING (doc_id))
SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N') || ':' || replica || ':7:order'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM repeated
"""
