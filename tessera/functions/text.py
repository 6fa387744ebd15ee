"""Column functions on names, hashes and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column, fallback: str = "item") -> Column:
    """Lower case with runs of other than ASCII letters and digits as one underscore, none at the ends."""
    key = F.btrim(F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_")), F.lit("_"))
    return F.when(F.length(key) > 0, key).otherwise(F.lit(fallback))


def label_part(name: Column) -> Column:
    """Each character that is no letter or digit as an underscore, none at the ends."""
    return F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"), F.lit("_"))


#: Escapes of a JSON string that have a name.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """The text as a JSON string in ASCII: quotes around it, other characters as \\uXXXX, beyond the BMP as two of these."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
    named = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        pair = F.concat(unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        plain = code.between(32, 126) & ~c.isin('"', "\\")
        return F.when(plain, c).otherwise(F.coalesce(F.element_at(named, c), F.when(code > 0xFFFF, pair).otherwise(unit(code))))

    simple = F.regexp_like(text, F.lit(r'\A[\x20\x21\x23-\x5B\x5D-\x7E]*\z'))
    whole = F.when(simple, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), whole, F.lit('"'))


def json_object(fields: Mapping[str, Column]) -> Column:
    """A JSON object of named JSON values, in the order of the names, without white space."""
    parts = [x for i, k in enumerate(sorted(fields)) for x in (F.lit(f'{"," if i else ""}"{k}":'), fields[k])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_list(values: Column) -> Column:
    """A JSON list of an array of JSON values."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def json_hash(text: Column) -> Column:
    """SHA-256 of the text as a JSON string, quotes and escapes included."""
    return F.sha2(json_string(text), 256)


def messages_hash(messages: Column) -> Column:
    """SHA-256 of a list of messages (role, content) as JSON."""
    return F.sha2(json_list(F.transform(messages, lambda m: json_object({"role": json_string(m["role"]), "content": json_string(m["content"])}))), 256)


def hash_shard(digest: Column, shards: int) -> Column:
    """The first 16 hex digits as an unsigned number, modulo shards."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("int")


def fill_template(template: str, columns: Mapping[str, Column]) -> Column:
    """The template with each {name} replaced by its column; a null value makes the text "None".

    KeyError names a placeholder without a column. Doubled braces are literal.
    """
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def has_word(text: Column, word: Column) -> Column:
    """Whether the lower-cased text has the lower-cased word, between word boundaries."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"\b\Q"), F.lower(word), F.lit(r"\E\b")))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last occurrence of mark, without white space before it; the whole text if there is none."""
    return F.ltrim(F.substring_index(text, mark, -1))


def first_digit(text: Column, low: int, high: int) -> Column:
    """The first digit from low to high that stands alone, as an int; null if there is none."""
    found = F.regexp_extract(text, rf"(?<![0-9A-Za-z_])([{low}-{high}])(?![0-9A-Za-z_])", 1)
    return F.when(found != "", found.cast("int"))


def judge_score(text: Column, low: int = 0, high: int = 3) -> Column:
    """The field score of a JSON object, or else the first lone digit in range."""
    parsed = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.score").try_cast("int")
    return F.when(parsed.between(low, high), parsed).otherwise(first_digit(text, low, high))
