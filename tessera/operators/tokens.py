"""Token positions: selection, spans, sections and pooling of long tables (example_key, layer, token_pos, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles, mean_vectors


def last_token(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The values at the greatest position of each group."""
    return tokens.groupBy(*keys).agg(F.max("token_pos").alias("token_pos"), F.max_by("values", "token_pos").alias("values"))


def slice_tokens(tokens: DataFrame, start: int, stop: int | None) -> DataFrame:
    """Positions from start to before stop; negative ones count from the end of their example's tokens."""
    if start >= 0 and (stop is None or stop >= 0):
        return tokens.where((F.col("token_pos") >= start) & (F.lit(True) if stop is None else F.col("token_pos") < stop))
    ends = tokens.groupBy("example_key").agg((F.max("token_pos") + 1).alias("_n"))
    bound = lambda b: F.lit(b) if b >= 0 else F.greatest(F.col("_n") + b, F.lit(0))
    cut = tokens.join(ends, "example_key").where(F.col("token_pos") >= bound(start))
    return (cut if stop is None else cut.where(F.col("token_pos") < bound(stop))).drop("_n")


def full_sequence(tokens: DataFrame) -> DataFrame:
    """All tokens, with index and n_tokens: the place among the tokens of their example and layer, and how many there are."""
    keys = [c for c in ("example_key", "layer") if c in tokens.columns]
    group = Window.partitionBy(*keys)
    return tokens.withColumns({"index": F.row_number().over(group.orderBy("token_pos")) - 1, "n_tokens": F.count("*").over(group)})


def select_section(tokens: DataFrame, sections: DataFrame, name: str) -> DataFrame:
    """Tokens of the named section (example_key, section, token_pos); ValueError, with a sample, if an example has no token in it."""
    chosen = in_sections(tokens, sections.where(F.col("section") == name))
    gone = tokens.select("example_key").distinct().join(chosen.select("example_key"), "example_key", "left_anti")
    lacking = sorted(r[0] for r in gone.limit(5).collect())
    if lacking:
        raise ValueError(f"examples without a token in section {name!r}, such as {lacking}")
    return chosen.drop("section")


def pool_positions(tokens: DataFrame, positions: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """keys, values, n_tokens: the tokens at listed positions (keys, place, token_pos), pooled in the order of place.

    A position that comes twice counts twice in the mean; first and last are those of the list, not of the text. A listed position without a token is an error.
    """
    rows = positions.join(tokens, [*keys, "token_pos"], "left")
    given = F.when(F.col("values").isNull(), F.raise_error(F.concat(F.lit("no token at position "), F.col("token_pos").cast("string")))).otherwise(F.col("values"))
    rows = rows.select(*keys, "place", given.alias("values"))
    if how == "mean":
        return mean_vectors(rows, keys, "values", "n_tokens")
    pick = {"first": F.min_by, "last": F.max_by}[how]
    return rows.groupBy(*keys).agg(pick(doubles("values"), F.col("place")).alias("values"), F.count("*").alias("n_tokens"))


def missing_sections(tokens: DataFrame, sections: DataFrame, name: str) -> DataFrame:
    """Keys of examples that lack the named section, which a selection by section must not have."""
    return tokens.select("example_key").distinct().join(sections.where(F.col("section") == name), "example_key", "left_anti")


def pooled_sections(sections: DataFrame) -> DataFrame:
    """Sections (example_key, section, token_pos) after their tokens were pooled into one: position 0, and how many there
    were."""
    return sections.distinct().groupBy("example_key", "section").agg(F.lit(0).alias("token_pos"), F.count("*").alias("overlap"))


def pool(tokens: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """One vector for each group: the mean, or the values at the first or last position."""
    if how == "mean":
        return mean_vectors(tokens, keys, "values", "n_tokens")
    pick = {"first": F.min_by, "last": F.max_by}[how]
    return tokens.groupBy(*keys).agg(pick(doubles("values"), F.col("token_pos")).alias("values"), F.count("*").alias("n_tokens"))


def in_sections(tokens: DataFrame, sections: DataFrame) -> DataFrame:
    """Tokens in sections (example_key, section, token_pos): a row per section that holds the position."""
    return tokens.join(sections.distinct(), ["example_key", "token_pos"])


def contiguous_spans(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open spans [start, stop) of the runs of consecutive positions in each group; repeated positions count once."""
    runs = positions.select(*keys, "token_pos").distinct()
    run = F.col("token_pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("token_pos"))
    found = runs.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("token_pos").alias("start"), (F.max("token_pos") + 1).alias("stop"))
    return found.drop("_run")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of half-open spans; spans that touch are merged."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    grouped = marked.withColumn("_group", F.sum("_new").over(order)).groupBy(*keys, "_group")
    return grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_group")


def rebase(positions: DataFrame, captured: DataFrame, keys: list[str]) -> DataFrame:
    """Positions as indexes into the captured ones of their group; those not captured go."""
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("token_pos")) - 1
    return positions.join(captured.select(*keys, "token_pos").distinct().withColumn("index", index), [*keys, "token_pos"])


def overlap(spans: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, name, token_pos) of tokens (start, stop) that overlap named character spans (begin, end) of the same key.

    A token without characters overlaps nothing. The join is on the key, the overlap a condition on top of it.
    """
    met = (F.col("stop") > F.col("start")) & (F.col("stop") > F.col("begin")) & (F.col("start") < F.col("end"))
    return spans.join(tokens, key).where(met).select(key, "name", "token_pos")


def section_tokens(spans: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """overlap(), and ValueError, with a sample, if a span has characters and no token."""
    found = overlap(spans, tokens, key)
    gone = spans.where(F.col("end") > F.col("begin")).select(key, "name").join(found.select(key, "name"), [key, "name"], "left_anti")
    lacking = sorted(map(tuple, gone.limit(5).collect()))
    if lacking:
        raise ValueError(f"sections without tokens, such as {lacking}")
    return found


def words_with_offsets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token_pos, token, start, stop): runs of letters, single digits and other characters, and their offsets."""
    tokens = F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]|\s+"), 0)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,stop:int>>").alias("all"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t)).alias("at"),
        F.concat(acc["all"], F.array(F.struct(t.alias("token"), acc["at"].alias("start"), (acc["at"] + F.length(t)).alias("stop")))).alias("all"),
    )
    placed = F.filter(F.aggregate(tokens, empty, step, lambda acc: acc["all"]), lambda t: F.trim(t["token"]) != "")
    return rows.select(key, F.posexplode(placed).alias("token_pos", "_t")).select(key, "token_pos", "_t.*")


def chat_turns(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, name, role, index, begin, end): where each turn's text lies in the rendered conversation.

    It is rendered as "Role: text" joined by blank lines, in the order of `turn`; names are {role}_turn_{i:03d}.
    """
    order = Window.partitionBy(conversation).orderBy("turn")
    head = F.length("role") + 2
    size = head + F.length("text")
    before = F.coalesce(F.sum(size + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = F.row_number().over(order) - 1
    placed = turns.withColumn("_before", before).withColumn("index", index)
    name = F.format_string("%s_turn_%03d", "role", "index")
    begin = F.col("_before") + head
    return placed.select(conversation, name.alias("name"), "role", "index", begin.alias("begin"), (begin + F.length("text")).alias("end"))


def render_chat(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, rendered): "Role: text" of all turns in order, joined by blank lines."""
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.col("text")).alias("line"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("rendered"))


def section_positions(sections: Column) -> Column:
    """Distinct positions of an array, in ascending order."""
    return F.array_sort(F.array_distinct(sections))
