"""Queries on stories, dialogues, JSON values and positions in rendered prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dialogue as dl
from tessera.plans.registry import query, table

_MORE = "chr(10) || chr(10)"


@query(f"""
WITH c AS (SELECT conv_id, turn, text, turn % 5 AS k FROM conversations)
SELECT conv_id, turn, md5(CASE k WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) WHEN 2 THEN trim(text) || {_MORE} || 'The end.' WHEN 3 THEN '' ELSE trim(text) || {_MORE} || 'Fin.' END) AS digest FROM c
""")
def txt_story_trim(spark, sf_dir):
    nl = "\n\n"
    said = (
        F.when(F.col("turn") % 10 == 0, F.concat("text", F.lit(f"{nl}Told without using the\n word, as a direct\nsynonym would.{nl}More.")))
        .when(F.col("turn") % 5 == 0, F.concat("text", F.lit(f"{nl}Note that all names are invented.{nl}More.")))
        .when(F.col("turn") % 5 == 1, F.concat("text", F.lit(f"{nl}Here are the\nfive stories.{nl}Rest")))
        .when(F.col("turn") % 5 == 2, F.concat("text", F.lit(f"{nl}The end. Let me know if you want me to revise them.{nl}X")))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit(f"I hope these are accurate.{nl}"), "text"))
        .otherwise(F.concat("text", F.lit(f"{nl}Fin.\n \n\n")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(dl.trim_story(said)).alias("digest"))


@query("""
WITH c AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT conv_id, turn, md5(trim(CASE WHEN turn % 2 = 0 THEN 'Human: ' || t || chr(10) || 'Assistant: yes, Assistant:' ELSE t END, chr(32) || chr(9) || chr(10) || chr(13))) AS digest FROM c
""")
def txt_dialogue_normalize(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure, here it is:\n  Person: "), flat, F.lit("\nAI: yes, AI:"))).otherwise(flat)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(dl.normalize_dialogue(said)).alias("digest"))


@query("""
WITH c AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS t FROM conversations WHERE turn % 3 <> 2)
SELECT conv_id, turn, i::INT AS place, CASE i WHEN 1 THEN 'AI' ELSE 'Person' END AS speaker, md5(CASE i WHEN 1 THEN 'Well.' ELSE t END) AS digest FROM c, range(CASE WHEN turn % 3 = 0 THEN 2 ELSE 3 END) r(i)
""")
def txt_dialogue_turns(spark, sf_dir):
    """Some end with a speaker without words, some begin with the wrong one and are no dialogue."""
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    said = F.concat(F.lit("Title\nPerson: "), flat, F.lit("\n\nAI: Well.\n"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(said, F.lit("Person:  \n"))).when(F.col("turn") % 3 == 1, F.concat(said, F.lit("Person : "), flat)).otherwise(F.concat(F.lit("AI: x\n"), said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(dl.dialogue_turns(said)).alias("place", "t"))
    return rows.select("conv_id", "turn", "place", "t.speaker", F.md5("t.said").alias("digest"))


@query("""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+|\\d+|[!?.,]') AS w, range(3, 43) AS p FROM benchmark),
d AS (SELECT item_id, p, w, i, CASE WHEN len(w) = 1 THEN len(p) // 2 ELSE round_even((i - 1) * (len(p) - 1) / (len(w) - 1), 0)::INT END AS spot FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT item_id, p[spot + 1]::INT AS position, arg_max(w[i], i) AS label FROM d GROUP BY ALL
""")
def tok_spread_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(dl.spread_labels(F.col("text"), F.sequence(F.lit(3), F.lit(42)))).alias("e"))
    return rows.select("item_id", "e.position", "e.label")


@query("""
WITH c AS (SELECT conv_id, turn, 'ASSISTANT: a' || chr(10) || replace(text, ':', ';') AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN length(t) + 11 WHEN 1 THEN length(t) + 11 ELSE -1 END::INT AS colon FROM c
""")
def tok_assistant_colon(spark, sf_dir):
    said = F.replace("text", F.lit(":"), F.lit(";"))
    whole = F.concat(F.lit("ASSISTANT: a\n"), said)
    rendered = F.when(F.col("turn") % 3 == 0, F.concat(whole, F.lit("\n\nAssistant: "))).when(F.col("turn") % 3 == 1, F.concat(whole, F.lit("\n\nassistant\n"))).otherwise(F.lit("nobody"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dl.assistant_colon(rendered).alias("colon"))


@query("""
WITH r AS (SELECT conv_id, string_agg('<' || text || '>', '' ORDER BY turn) AS t, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, turn, length(text) AS n, (sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::INT AS spot FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, spot AS begin, (spot + n)::INT AS "end" FROM o
""")
def sec_located_turns(spark, sf_dir):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    whole = whole.withColumn("rendered", F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))
    rows = whole.select("conv_id", F.posexplode(dl.located_turns("rendered", "turns")).alias("place", "s"))
    return rows.select("conv_id", "place", "s.begin", "s.end")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ->> '$.k' END AS k FROM events")
def txt_mapping(spark, sf_dir):
    given = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(dl.mapping(given), "k").alias("k"))


@query("SELECT conv_id, turn, md5(text || ' !') AS digest FROM conversations")
def txt_content_text(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", F.lit("x")), part("text", F.lit(None).cast("string")), part("text", F.lit(" !")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(dl.content_text(parts)).alias("digest"))


@query("""SELECT doc_id, 'ex_' || substr(sha256('["' || coalesce(lang, '') || '","' || coalesce(source, '') || '","' || doc_id || '"]'), 1, 16) AS row_id FROM documents""")
def ds_row_id(spark, sf_dir):
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", dl.row_id("ex_", text("lang"), text("source"), F.col("doc_id")).alias("row_id"))


@query("""SELECT conv_id, turn, '[{"name":"' || role || '","index":' || turn || '}]' AS sections FROM conversations""")
def sec_json_build(spark, sf_dir):
    record = F.to_json(F.array(F.struct(F.col("role").alias("name"), F.col("turn").alias("index"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("sections"))


@query("SELECT conv_id, count(*) FILTER (role = 'system') > 0 AS has_system FROM conversations GROUP BY conv_id")
def sec_path_exists(spark, sf_dir):
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.struct(F.col("role").alias("kind")).alias("spec"))).alias("steps"))
    return listed.select("conv_id", F.exists("steps", lambda s: s["spec"]["kind"] == "system").alias("has_system"))


@query("SELECT doc_id, lang FROM documents WHERE length(text) >= 400 AND lang IN ('en', 'fr') AND coalesce(source, '') <> 'src1'")
def ds_text_filters(spark, sf_dir):
    from tessera.operators.select import text_filter

    return text_filter(table(spark, sf_dir, "documents"), "text", 400, {"lang": ["en", "fr"]}, F.coalesce(F.col("source") != "src1", F.lit(True))).select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'view' AND event_type IS NOT NULL AND event_id % 4 IN (0, 3)")
def ds_score_roles(spark, sf_dir):
    from tessera.operators.select import scored_roles

    rows = table(spark, sf_dir, "events").withColumn("score", (F.col("event_id") % 4).cast("double").cast("int").cast("string"))
    return scored_roles(rows, "event_type", "view", "score", ["0", "3"]).select("event_id", "user_id")


@query("""
WITH b AS (SELECT item_id, length(text) AS n FROM benchmark)
SELECT item_id, 'body' AS name, 1::BIGINT AS n_positions FROM b UNION ALL SELECT item_id, 'tail', 2 FROM b WHERE n % 2 = 0
""")
def sec_coerce(spark, sf_dir):
    from tessera.operators.select import coerced_sections

    tail = F.when(F.length("text") % 2 == 0, F.lit("[4, 5]")).otherwise(F.lit("[]"))
    given = F.concat(F.lit('[{"section_name": "body", "positions": [3]}, {"name": "tail", "token_positions": '), tail, F.lit("}]"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", given.alias("sections"))
    found = rows.select("item_id", F.explode(coerced_sections(F.col("sections"))).alias("s"))
    return found.select("item_id", "s.name", F.size("s.token_positions").cast("long").alias("n_positions"))
