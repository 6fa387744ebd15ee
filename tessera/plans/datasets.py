"""Queries on examples: sources, selection, alignment, labels and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.functions.text import hash_shard, json_hash, label_part, messages_hash, name_key
from tessera.operators import select
from tessera.plans.registry import query, table
from tessera.sources import examples as src


@query("SELECT doc_id::VARCHAR AS example_key, lang || ': ' || source AS prompt, lang AS label_lang, source AS case_source, n_chars AS meta_n_chars FROM documents")
def ds_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return src.examples(docs, "doc_id", template="{lang}: {source}", labels=["lang"], cases=["source"], metadata=["n_chars"])


@query("SELECT doc_id, 'Document ' || doc_id || ' from ' || source || ' {' || lang || '}' AS prompt FROM documents")
def ds_template(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", src.fill_template("Document {doc_id} from {source} {{{lang}}}", {c: F.col(c) for c in docs.columns}).alias("prompt"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def ds_predicate(spark, sf_dir):
    return select.where_label(table(spark, sf_dir, "documents"), "lang", "de").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def ds_select(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return select.select_rows(table(spark, sf_dir, "documents"), "doc_id", good).select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def ds_align_semi(spark, sf_dir):
    return select.align(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def ds_missing_anti(spark, sf_dir):
    return select.missing_keys(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side
FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL
""")
def ds_key_differences(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return select.key_differences(left, right, "k")


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'view' THEN 'look' ELSE 'other' END AS mapped FROM events
""")
def ds_label_map(spark, sf_dir):
    mapping = {"click": "act", "purchase": "act", "view": "look"}
    return select.map_label(table(spark, sf_dir, "events"), "event_type", mapping, "other").select("event_id", "mapped")


@query("SELECT event_id, props ->> '$.k' AS k, props ->> '$.none' AS missing FROM events")
def ds_label_fields(spark, sf_dir):
    return select.label_fields(table(spark, sf_dir, "events"), "props", {"k": "k", "missing": "none"}).select("event_id", "k", "missing")


@query("""
WITH l AS (SELECT doc_id, string_split(lang || ';' || source || ' ; ', ';') AS p, string_split('not ' || lang || ';x', ';') AS n FROM documents),
x AS (SELECT doc_id, 'positive' AS side, list_filter(list_transform(p, lambda s: trim(s)), lambda s: s <> '') AS items FROM l
      UNION ALL SELECT doc_id, 'negative', list_filter(list_transform(n, lambda s: trim(s)), lambda s: s <> '') FROM l)
SELECT format('{:06d}_{}_{:03d}', doc_id, side, i - 1) AS example_key, side, items[i] AS item FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM x)
""")
def ds_list_contrast(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.format_string("%06d", "doc_id")
    positive = F.concat(F.col("lang"), F.lit(";"), F.col("source"), F.lit(" ; "))
    return src.list_contrast(docs, key, positive, F.concat(F.lit("not "), F.col("lang"), F.lit(";x")))


@query("""
SELECT r_regionkey AS instruction_id, 'You are toy in ' || r_name AS instruction, n_nationkey AS question_id, n_name AS question,
       format('i{:03d}_q{:03d}', r_regionkey, n_nationkey) AS example_key FROM region, nation
""")
def ds_prompt_expand(spark, sf_dir):
    instructions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("instruction_id"), F.concat(F.lit("You are {model_name} in "), "r_name").alias("instruction"))
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id"), F.col("n_name").alias("question"))
    return src.expand_prompts(instructions, questions, "toy")


@query("SELECT doc_id, sha256(text) AS digest, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 7)::INT AS shard FROM documents")
def ds_hash_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.withColumn("shard", hash_shard(F.col("digest"), 7))


@query("""SELECT c_custkey, sha256('"' || c_name || '"') AS prompt_hash FROM customer""")
def ds_prompt_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", json_hash(F.col("c_name")).alias("prompt_hash"))


_JSON = """'"' || array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(9) THEN '\\t'
  WHEN unicode(c) > 65535 THEN '\\u' || format('{{:04x}}', ((unicode(c) - 65536) >> 10) + 55296) || '\\u' || format('{{:04x}}', ((unicode(c) - 65536) & 1023) + 56320)
  WHEN unicode(c) < 32 OR unicode(c) > 126 THEN '\\u' || format('{{:04x}}', unicode(c)) ELSE c END), '') || '"'"""


@query(f"""
SELECT conv_id, sha256('[' || string_agg('{{"content":' || {_JSON.format("text || chr(9) || '日😀' || chr(92) || chr(34)")} || ',"role":"' || role || '"}}', ',' ORDER BY turn) || ']') AS prompt_hash FROM conversations GROUP BY conv_id
""")
def ds_messages_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("content", F.concat("text", F.lit("\t日😀\\\"")))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return rows.groupBy("conv_id").agg(listed.alias("m")).select("conv_id", messages_hash(F.col("m")).alias("prompt_hash"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 300")
def ds_paging(spark, sf_dir):
    return src.page(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], 100, 3).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, format('hf_{:06d}', row_number() OVER (ORDER BY doc_id) - 1) AS example_key FROM documents")
def ds_index_keys(spark, sf_dir):
    return src.index_keys(table(spark, sf_dir, "documents"), "hf", ["doc_id"]).select("doc_id", "example_key")


@query("""
WITH j AS (SELECT c_custkey, i FROM customer, unnest(range((c_custkey % 4)::BIGINT)) AS t(i))
SELECT c_custkey, i::INT AS index, 't' || i AS title, (10 * i)::BIGINT AS weight FROM j
""")
def ds_explode_records(spark, sf_dir):
    one = lambda i: F.concat(F.lit('{"name": "t'), i.cast("string"), F.lit('", "weight": '), (i * 10).cast("string"), F.lit("}"))
    n = (F.col("c_custkey") % 4).cast("int")
    listed = F.when(n > 0, F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one), ", "), F.lit("]")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", listed.alias("rubric"))
    found = src.explode_records(rows, "rubric", fields={"title": ["title", "name"], "weight": ["weight"]}, schema="array<struct<title:string,name:string,weight:bigint>>")
    return found.select("c_custkey", "index", "title", "weight")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '--X'), '[^a-z0-9]+', '_', 'g'), '_') AS key, trim(regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g'), '_') AS part FROM part")
def ds_name_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", name_key(F.concat("p_name", F.lit("--X"))).alias("key"), label_part(F.col("p_name")).alias("part"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3")
def ds_group_cap(spark, sf_dir):
    capped = select.cap_groups(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3)
    return capped.select("source", "doc_id", "rank")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def ds_dedupe_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return select.first_by(docs, ["digest"], [F.col("doc_id")])


def _text(value: str) -> str:
    return f"coalesce({value}, 'none')"


#: Records about a document in three shapes: a list, a list under a key, an object of objects.
_ONE = f"""'{{"title": "lang ' || {_text("lang")} || '", "weight": 2, "annotations": {{"Dimension": "' || {_text("source")} || '"}}}}'"""
_TWO = """'{"criterion": "n ' || n_chars || '", "weight": -3}'"""
_SHAPES = f"""CASE doc_id % 3 WHEN 0 THEN '[' || {_ONE} || ', ' || {_TWO} || ']' WHEN 1 THEN '{{"note": 1, "criteria": [' || {_ONE} || ', ' || {_TWO} || ']}}'
  ELSE '{{"z": ' || {_ONE} || ', "a": ' || {_TWO} || '}}' END"""


@query(f"""
SELECT doc_id, 0 AS place, 'lang ' || {_text("lang")} AS criterion_text, {_text("source")} AS dimension, 2 AS weight, left(sha256('{{"lang":"' || {_text("lang")} || '"}}'), 24) AS base FROM documents
UNION ALL SELECT doc_id, 1, 'n ' || n_chars, NULL, -3, left(sha256('{{"lang":"' || {_text("lang")} || '"}}'), 24) FROM documents
""")
def ds_nested_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_text("lang")).alias("lang"), F.expr(_SHAPES).alias("records"))
    paths = {"criterion_text": ("title", "criterion"), "dimension": "annotations.dimension", "weight": "weight"}
    found = nested.hash_columns(nested.explode_nested(rows, "records", paths, "place", {"weight": "int"}), {"base": "lang"})
    return found.select("doc_id", "place", "criterion_text", "dimension", "weight", "base")


@query(f"""
SELECT doc_id, sha256('{{"a":[' || doc_id || ',[],{{"b":null,"lang":"' || {_text("lang")} || '"}}],"n":2.5,"source":"' || {_text("source")} || '","z":true}}') AS text_hash,
       sha256('{{"k":{{"lang":"' || {_text("lang")} || '","source":"' || {_text("source")} || '"}},"n":[' || n_chars || ',null]}}') AS column_hash
FROM documents
""")
def ds_canonical_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.expr(_text("lang")).alias("lang"), F.expr(_text("source")).alias("source"))
    text = """'{"z": true, "source": "' || source || '", "n": 2.50, "a": [' || doc_id || ', [], {"lang": "' || lang || '", "b": null}]}'"""
    rows = rows.withColumn("value", F.try_parse_json(F.expr(text)))
    rows = rows.withColumn("nest", F.struct(F.array("n_chars", F.lit(None).cast("long")).alias("n"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("k")))
    return rows.select("doc_id", nested.stable_hash(rows, "value").alias("text_hash"), nested.stable_hash(rows, "nest").alias("column_hash"))
