"""Column functions on generated stories and dialogues, JSON values and positions in a rendered prompt."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


# Openings of a paragraph about the stories, with what its text must also have, in lower case ---------
META_OPENINGS = (
    (r"(?:please\s+)?note(?:\s+that)?\b", ()),
    (r"here are\b", ("stor",)),
    (r"as requested\b", ("stor",)),
    (r"i hope\b", ("requirements", "accurate", "adjustments", "prompt")),
    (r"please find\b", ("response",)),
    (r"let me know\b", ("prompt", "proceed")),
    (r"i can do this prompt\b", ()),
)
#: Phrases anywhere in such a paragraph, all of the first with any of the second.
META_PHRASES = (
    (("without using the word",), ("direct synonym", "convey the emotion", "requirements")),
    (("direct synonym", "convey"), ("emotion",)),
)
#: Phrases that end a paragraph where they begin, if any of the others follows.
INLINE_WITH = (
    ("let me know if", ("requirement", "stories", "instruction", "response", "revise", "adjustment", "improve", "feedback")),
    ("i hope", ("i hope you like them", "i hope this is accurate")),
    ("i have now completed", ("as requested",)),
)
#: After the first "i hope": this phrase, with any of the others.
INLINE_HOPE = ("i hope these", ("requirement", "prompt", "accurate", "adjustment"))
INLINE_ALONE = (
    "also, are there any other instructions",
    "also, please let me know",
    "please provide feedback",
    "thanks! (i have made",
    "please disregard",
    "the stories aim",
    "the stories explore",
    "to further enhance the stories",
)
# ---------------------------------------------------------------------------------------------------------------------


def is_story_meta(paragraph: Column) -> Column:
    """Whether a paragraph is about the stories instead of one of them; a phrase may go on over the ends of lines."""
    lines = F.transform(F.split(paragraph, r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]+", -1), _strip)
    low = F.lower(F.array_join(F.filter(lines, lambda x: x != ""), " "))
    has = lambda words: _any([F.contains(low, F.lit(w)) for w in words])
    tests = [F.regexp_like(low, F.lit(rf"^{opening}")) & (has(words) if words else F.lit(True)) for opening, words in META_OPENINGS]
    tests += [reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in every]) & has(some) for every, some in META_PHRASES]
    return _any(tests)


def before_inline_meta(paragraph: Column) -> Column:
    """The paragraph up to the earliest phrase about the stories; the whole of it if there is none."""
    low = F.lower(paragraph)
    at = lambda phrase: F.instr(low, phrase)
    tail = lambda phrase: F.substring(low, at(phrase), F.length(low))
    after = lambda phrase, words: _any([F.contains(tail(phrase), F.lit(w)) for w in words])
    starts = [F.when((at(p) > 0) & after(p, words), at(p)) for p, words in INLINE_WITH]
    starts.append(F.when((at("i hope") > 0) & after("i hope", INLINE_HOPE[:1]) & after("i hope", INLINE_HOPE[1]), at("i hope")))
    starts += [F.when(at(p) > 0, at(p)) for p in INLINE_ALONE]
    first = F.array_min(F.array(*starts))
    return F.when(first.isNull(), paragraph).otherwise(_strip(F.substring(paragraph, F.lit(1), first - 1)))


def trim_story(story: Column) -> Column:
    """Paragraphs of a story, joined by blank lines, up to the first that is about the stories or is cut within."""
    parts = F.filter(F.transform(F.split(_strip(story), r"\n\s*\n", -1), _strip), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.struct(is_story_meta(p).alias("meta"), before_inline_meta(p).alias("kept"), p.alias("whole")))

    def step(acc: Column, p: Column) -> Column:
        done = acc["done"] | p["meta"]
        kept = F.when(done | (p["kept"] == ""), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p["kept"])))
        return F.struct(kept.alias("kept"), (done | (p["kept"] != p["whole"])).alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))
    return F.aggregate(cut, start, step, lambda acc: F.array_join(acc["kept"], "\n\n"))


def normalize_dialogue(text: Column) -> Column:
    """The text from the first line of a Person or Human on, with speakers named Human and Assistant."""
    whole = _strip(text)
    at = F.regexp_instr(whole, F.lit(r"(?im)^\s*(?:Person|Human)\s*:"))
    cut = _strip(F.when(at > 0, F.substring(whole, at, F.length(whole))).otherwise(whole))
    return F.replace(F.replace(cut, F.lit("Person:"), F.lit("Human:")), F.lit("AI:"), F.lit("Assistant:"))


def dialogue_turns(text: Column) -> Column:
    """(speaker, said) of each line block that begins with "Person:" or "AI:"; blocks without words at the end go.

    Null unless the first speaker is a Person and an AI speaks after.
    """
    begins = r"(?m)(?=^\s*(?:Person|AI)\s*:)"
    parts = F.filter(F.transform(F.split(text, begins, -1), _strip), lambda p: F.regexp_like(p, F.lit(r"^(?:Person|AI)\s*:")))
    turns = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(Person|AI)", 1).alias("speaker"), _strip(F.regexp_replace(p, r"^(?:Person|AI)\s*:", "")).alias("said")))
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["said"] != "", i + 1).otherwise(0)))
    kept = F.slice(turns, F.lit(1), F.coalesce(last, F.lit(0)))
    fits = (F.get(kept, F.lit(0))["speaker"] == "Person") & F.exists(kept, lambda t: t["speaker"] == "AI")
    return F.when(fits, kept)


def spread_labels(text: Column, positions: Column) -> Column:
    """(position, label): words, numbers and marks of the text, dealt evenly over the sorted positions.

    Of m labels over n positions the i-th goes to place i (n - 1) / (m - 1), halves to the even; a single one goes to
    the middle. Later labels replace earlier ones of a place.
    """
    labels = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|\d+|[!?.,]"), 0)
    n, m = F.size(positions), F.size(labels)
    place = lambda i: F.when(m == 1, F.floor(n / 2)).otherwise(F.bround(i * (n - 1) / F.greatest(m - 1, F.lit(1)), 0)).cast("int")
    dealt = F.transform(labels, lambda x, i: F.struct(place(i).alias("at"), i.alias("i"), x.alias("x")))
    of = lambda k: F.element_at(F.filter(dealt, lambda d: d["at"] == k), -1)["x"]
    listed = F.transform(F.array_sort(positions), lambda p, k: F.struct(p.alias("position"), F.when(F.exists(dealt, lambda d: d["at"] == k), of(k)).alias("label")))
    return F.filter(listed, lambda e: e["label"].isNotNull())


def assistant_colon(rendered: Column) -> Column:
    """Place, from 0, of the colon after the last "assistant:" or "assistant" line, or of the line's end; -1 if none."""
    low = F.lower(rendered)
    last = lambda mark: F.when(F.contains(low, F.lit(mark)), F.length(low) - F.length(F.substring_index(low, mark, -1)) - len(mark))
    start = F.greatest(last("assistant:"), last("assistant\n"))
    rest = F.substring(rendered, start + 1, F.length(rendered))
    at = F.when(F.instr(rest, ":") > 0, F.instr(rest, ":")).when(F.instr(rest, "\n") > 0, F.instr(rest, "\n"))
    return F.coalesce(start + at - 1, F.lit(-1)).cast("int")


def located_turns(rendered: str, turns: str) -> Column:
    """(begin, end) of each text of an array in the rendered prompt: searched from the end of the one before, then
    anywhere; null if it is not there."""
    return F.expr(
        f"aggregate({turns}, named_struct('at', 1, 'spans', cast(array() as array<struct<begin:int,end:int>>)), (acc, t) -> "
        f"named_struct('at', if(locate(t, {rendered}, acc.at) > 0, locate(t, {rendered}, acc.at) + length(t), if(locate(t, {rendered}) > 0, locate(t, {rendered}) + length(t), acc.at)), "
        f"'spans', concat(acc.spans, array(if(locate(t, {rendered}) = 0, null, named_struct('begin', if(locate(t, {rendered}, acc.at) > 0, locate(t, {rendered}, acc.at), locate(t, {rendered})) - 1, "
        f"'end', if(locate(t, {rendered}, acc.at) > 0, locate(t, {rendered}, acc.at), locate(t, {rendered})) - 1 + length(t)))))), acc -> acc.spans)"
    )


def mapping(text: Column) -> Column:
    """A JSON object given as text, as a map of texts; null for other JSON and for what is none."""
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, "map<string,string>"))


def content_text(parts: Column) -> Column:
    """The texts of a message's parts (type, text), one after the other."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")


def row_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 16 hex digits of the SHA-256 of the parts as a JSON list of texts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 16))


def char_span(offsets: Column, first: Column, last: Column) -> Column:
    """(begin, end) in characters of the tokens from first to last, by their offsets (begin, end); null if out of range."""
    return F.when(F.get(offsets, last).isNotNull(), F.struct(F.get(offsets, first)["begin"].alias("begin"), F.get(offsets, last)["end"].alias("end")))
