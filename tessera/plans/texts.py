"""Queries on texts and chats: blocks, words, n-grams, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import after_last, judge_score
from tessera.operators import blocks, select, tokens
from tessera.operators.readouts import text_counts
from tessera.plans.registry import query, table


@query(r"""
WITH t AS (SELECT conv_id, string_agg('Story ' || (turn + 1) || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter(list_transform(string_split_regex(text, '(?im)^[ \t]*\[?[ \t]*story[ \t]+\d+[ \t]*\]?[ \t]*$')[2:], lambda b: trim(b, chr(32) || chr(9) || chr(13) || chr(10))), lambda b: b <> '') AS b FROM t)
SELECT conv_id, (i - 1)::INT AS index, md5(b[i]) AS digest FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM p)
""")
def txt_blocks(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("Story "), (F.col("turn") + 1).cast("string"), F.lit("\n"), F.col("text")).alias("t"))))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))
    return whole.select("conv_id", F.posexplode(blocks.labelled_blocks(F.col("text"), "story")).alias("index", "b")).select("conv_id", "index", F.md5("b").alias("digest"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '\\bthat\\b')")
def txt_exclude_word(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("word", F.lit("That"))
    return blocks.without_word(docs, "text", "word").select("doc_id")


@query("""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark),
g AS (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w))
SELECT item_id, term, count(*) AS count FROM g GROUP BY ALL
""")
def txt_ngrams(spark, sf_dir):
    return text_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""
WITH p AS (SELECT lang, len(list_filter(string_split(text, '.'), lambda s: trim(s) <> '')) AS n, CASE WHEN n_chars > 3000 THEN 'length' ELSE 'stop' END AS f FROM documents)
SELECT lang, count(*) AS n_rows, sum(n)::BIGINT AS n_parsed, 20 * count(*) AS n_expected, count(*) FILTER (f = 'length') AS n_length, sum(n) >= 20 * count(*) AS passed FROM p GROUP BY lang
""")
def txt_parse_qa(spark, sf_dir):
    parsed = F.filter(F.split("text", r"\.", -1), lambda s: F.trim(s) != "")
    finish = F.when(F.col("n_chars") > 3000, "length").otherwise("stop")
    rows = table(spark, sf_dir, "documents").select("lang", parsed.alias("parsed"), finish.alias("finish"))
    return blocks.parse_quality(rows, ["lang"], "parsed", 20, "finish")


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN (turn % 4)::INT WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 3 END AS score FROM conversations
""")
def txt_judge_score(spark, sf_dir):
    said = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit('Here: {"score": '), (F.col("turn") % 4).cast("string"), F.lit(', "why": "x"}')))
        .when(F.col("turn") % 4 == 1, F.lit("I would say 2, not 15."))
        .when(F.col("turn") % 4 == 2, F.lit("no score, 42"))
        .otherwise(F.lit('{"score": 9} so 3'))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judge_score(said).alias("score"))


_RENDER = """
r AS (SELECT *, length(role) + 2 AS head, length(role) + 2 + length(text) AS size FROM conversations),
s AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM r)
"""


@query(f"WITH {_RENDER} SELECT conv_id, format('{{}}_turn_{{:03d}}', role, i) AS name, role, i::INT AS index, place + head AS begin, place + size AS \"end\" FROM s")
def sec_chat_turns(spark, sf_dir):
    return tokens.chat_turns(table(spark, sf_dir, "conversations"))


@query("""
WITH r AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(t) AS digest, length(ltrim(string_split(t, 'Assistant:')[-1])) AS answer_chars FROM r
""")
def sec_render(spark, sf_dir):
    rendered = tokens.render_chat(table(spark, sf_dir, "conversations"))
    return rendered.select("conv_id", F.md5("rendered").alias("digest"), F.length(after_last(F.col("rendered"), "Assistant:")).cast("long").alias("answer_chars"))


@query("""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
t AS (SELECT item_id, i - 1 AS pos, (list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)))::BIGINT AS start, length(w[i]) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
s AS (SELECT item_id, 'head' AS name, 0 AS b, 30 AS e FROM benchmark UNION ALL SELECT item_id, 'mid', 25, 60 FROM benchmark)
SELECT item_id, name, pos::INT AS token_pos FROM t JOIN s USING (item_id) WHERE n > 0 AND coalesce(start, 0) + n > b AND coalesce(start, 0) < e
""")
def tok_char_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ", -1)
    start = lambda i: F.aggregate(F.transform(F.slice("w", F.lit(1), i), lambda x: F.length(x) + 1), F.lit(0), lambda a, x: a + x)
    placed = rows.select("item_id", words.alias("w")).select("item_id", F.posexplode(F.transform("w", lambda x, i: F.struct(start(i).alias("start"), F.length(x).alias("n")))).alias("token_pos", "t"))
    offsets = placed.select("item_id", "token_pos", "t.start", (F.col("t.start") + F.col("t.n")).alias("stop"))
    spans = rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("begin"), F.lit(e).alias("end")) for n, b, e in (("head", 0, 30), ("mid", 25, 60))])).alias("s"))
    return tokens.overlap(spans.select("item_id", "s.*"), offsets, "item_id")


@query("""
WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM s)
SELECT conv_id, (rank - 1)::INT AS place, role || '_' || turn AS name FROM r
""")
def sec_filter_order(spark, sf_dir):
    record = F.struct(
        F.concat_ws("_", "role", F.col("turn").cast("string")).alias("name"),
        F.col("turn").cast("int").alias("index"),
        F.array(F.col("turn").cast("int")).alias("token_positions"),
        F.create_map(F.lit("role"), F.col("role")).alias("tags"),
    )
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(record).alias("sections"))
    found = select.sections_where(rows, "sections", role="user")
    return found.select("conv_id", F.posexplode("sections").alias("place", "s")).select("conv_id", "place", "s.name")
