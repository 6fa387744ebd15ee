"""Quality rules: counts over each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed unigrams and bigrams of lower-cased words are fitted: one to the texts of trusted
documents, one to the whole corpus. A document's score is its mean log ratio per n-gram. Ratios are rounded to
integers of a millionth, so a sum, and with it the verdict, does not depend on the order of addition.

All of it is DataFrame expressions. What goes to the driver is one integer for each of a fixed number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.words import WORD

BUCKETS = 1 << 14
#: Documents that the trusted multinomial is fitted to, at most: those of the least hashes of their ids.
TRUSTED = 20_000
#: Documents with a lower mean log ratio are rejected.
THRESHOLD = -0.11
#: N-grams of the corpus that the trusted multinomial holds from the start: with few trusted texts, ratios stay near 0.
PRIOR = 20_000.0
_UNIT = 1_000_000
_WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def _grams(words: Column) -> Column:
    """Buckets of the unigrams and bigrams of words."""
    hashed = lambda *of: F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")
    before, after = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words))
    return F.concat(F.transform(words, lambda w: hashed(w)), F.zip_with(before, after, lambda v, w: hashed(v, w)))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", limit: int = TRUSTED) -> DataFrame:
    """At most `limit` ids with quality 1 and not toxic. Null ids and null qualities don't count; repeated ids count once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def fit_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The log ratio of each bucket in millionths: trusted documents against all rows of docs."""
    trusted = F.broadcast(trusted_ids(labels, id_col))  # TRUSTED rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.transform(_words(F.col(text_col)), lambda w: F.lower(w)).alias("words"))
    rows = rows.join(trusted, F.col("id") == F.col("trusted_id"), "left").select(F.col("trusted_id").isNotNull().alias("good"), _grams(F.col("words")).alias("grams"))
    counts = rows.select("good", F.explode_outer("grams").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))
    counts = Scratch(docs.sparkSession, "quality").write(counts, "counts")
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw = F.coalesce("raw", F.lit(0)) / F.lit(float(totals["raw"] or 1))
    target = (F.coalesce("target", F.lit(0)) + PRIOR * raw) / F.lit(PRIOR + (totals["target"] or 0))
    weight = F.when(raw > 0, F.round(F.ln(target / raw) * _UNIT)).otherwise(0).cast("int")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    table = every.join(F.broadcast(counts), "bucket", "left")  # BUCKETS rows at most
    return [r["weight"] for r in table.select("bucket", weight.alias("weight")).orderBy("bucket").collect()]


def _base(text: Column, words: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "lines": lines,
    }


def _covered(repeats: Column) -> Column:
    """Words that lie in a window which begins at one of the sorted positions."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct((p + _WINDOW).alias("end"), (acc.n + (p + _WINDOW - F.greatest(p, acc.end)).cast("long")).alias("n"))
    return F.aggregate(repeats, start, step, lambda acc: acc.n)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """The columns carry (by default id_col), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    words (lower-cased) for each row."""
    carry = [*(carry or [id_col])]
    held = [F.col(f"`{c}`") for c in carry]
    text = F.col(text_col)
    rows = docs.select(F.struct(*held).alias("_held"), text.alias("_text"), _words(text).alias("raw_words"))
    rows = rows.select(
        "_held",
        *(c.alias(n) for n, c in _base(F.col("_text"), F.col("raw_words")).items()),
        F.transform("raw_words", lambda w: F.lower(w)).alias("words"),
        F.when(
            F.size("raw_words") >= _WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("raw_words") - _WINDOW + 1), lambda i: F.xxhash64(F.slice("raw_words", i, _WINDOW))),
        ).alias("windows"),
    )
    # Only where some window is there twice are the windows sorted, with their places, to find which.
    entry = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("entries", F.when(twice, F.array_sort(F.transform("windows", entry))))
    rows = rows.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<h:bigint,i:int>>")))
    follows = F.zip_with("entries", F.slice("entries", F.lit(2), F.size("entries")), lambda a, b: a.h == b.h)
    either = F.zip_with(follows, F.concat(F.array(F.lit(False)), follows), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    places = F.zip_with("entries", either, lambda e, repeated: F.when(repeated, e.i))
    repeats = F.array_sort(F.filter(places, lambda i: i.isNotNull()))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_covered(repeats), F.lit(0)).cast("long"))
    return rows.select(
        "_held",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        "words",
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of docs: id_col (or the columns of docs named in carry), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_grams, score_sum. A carried column with one of these names is replaced.

    kept is false where base_failed, else whether the mean log ratio, score_sum / n_grams in millionths, is at least
    the threshold. A null or empty text has no words and fails the base rules. Null and repeated ids are kept as rows.
    labels has id_col, quality and toxic; without trusted rows every ratio is 0. _row numbers
    the rows of the scan. Other columns are ignored; an empty table gives no rows. Windows of 8 words are told apart by 64-bit hashes within their text.
    """
    weights = F.expr(f"array({','.join(map(str, fit_weights(docs, labels, id_col, text_col)))})")  # folded to one literal
    rows = rule_counts(docs, id_col, text_col, carry).withColumn("grams", _grams(F.col("words"))).drop("words")
    score = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get(weights, g))
    rows = rows.withColumn("n_grams", F.size("grams").cast("long")).withColumn("score_sum", score).drop("grams")
    passed = F.col("score_sum") >= F.lit(round(threshold * _UNIT)) * F.col("n_grams")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "score_sum"]
    held = [F.col(f"_held.`{c}`") for c in carry or [id_col] if c not in names]
    # A filter on both `kept` and the row number stays above this step; pushed below it, the rules would be worked out
    # again for every place where they are named.
    judged = rows.withColumn("kept", ~F.col("base_failed") & passed).withColumn("_row", F.monotonically_increasing_id())
    return judged.select(*held, *names, "_row")


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with the columns of docs."""
    judged = quality_rules(docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), labels.withColumnRenamed(id_col, "_id"), "_id", "_text", threshold, carry=["_doc"])
    return judged.where("kept and _row >= 0").select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("_row")
