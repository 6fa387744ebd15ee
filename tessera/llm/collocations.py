"""Phrase collocation mining by stripes.

A prefix of words keys a stripe: an associative array of the words that follow it, with counts. Tasks build stripes of
the texts they read and pack those that are to be merged in one place; stripes of one key are merged elementwise. All that is asked of a phrase is in the merged
stripes: an entry is the frequency of an extension, the sum of the empty prefix's stripe is the number of words, the
parts of a cut are entries too, and the greatest entry that extends a phrase to the right or left decides whether it is
subsumed.

A phrase is no more frequent than any part of it, so stripes are built level by level: of words; of pairs of frequent
words; of longer phrases all pairs of which are frequent. What is frequent is told to the tasks by a filter of bounded size (a
wrong yes costs an entry, not a result).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.words import mix, word_blocks

#: Bits of a filter: so many for each phrase, as far as the greatest size (64 MB) goes; beyond it more entries are shuffled.
BITS_PER_PHRASE, MOST_BITS = 24, 1 << 29
#: Words of the texts that a task counts before it emits stripes.
FLUSH_WORDS = 3_000_000
#: Parts that a stripe is dealt in by a hash of the following word: of the empty prefix, and of any other.
_DEALT_ALL, _DEALT = 512, 16
#: Entries that a task reads before it merges them with those that it has.
_HELD = 2_000_000

_END = b"\xff"  # no byte of UTF-8; stands for the end of a piece
#: A-Z in lower case, and the ends of pieces.
_TABLE = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_PACKED = "part int, lang string, stripes binary"
_MERGED = "lang string, size int, prefix string, total long, words array<string>, counts array<long>"


def _word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9E3779B97F4A7C15) + second)


class Members:
    """A filter of 64-bit hashes with two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each hash in a filter of so many bits, a power of two."""
        return hashes & _U(size - 1), (hashes >> _U(32)) & _U(size - 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, len(self.bits) * 8):
            found &= (self.bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return found


class _Counter:
    """Counts the words or phrases of texts by language, and gives them out as stripes."""

    def __init__(self, sizes: Sequence[int], parts: int, words: Members | None, pairs: Members | None):
        self.sizes, self.parts, self.words, self.pairs = sizes, parts, words, pairs
        self._clear()

    def _clear(self) -> None:
        self.ids, self.texts, self.held = {_END: 0}, {}, 0

    def add(self, lang: str, text: bytes) -> None:
        ids = self.ids
        for words in word_blocks(text.translate(_TABLE).replace(_END, b" " + _END + b" ")):
            self.texts.setdefault(lang, []).append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int32))
            self.held += len(words)
        if text:
            self.texts.setdefault(lang, []).append(np.zeros(1, np.int32))

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = list(self.ids)
        vocabulary = pa.array(names, pa.binary())
        dealt = np.fromiter((_word_hash(w, 1) & 0x7FFFFFFF for w in names), np.int64, len(names))
        for lang, texts in self.texts.items():
            row = np.concatenate(texts)
            if 1 in self.sizes:
                counts = np.bincount(row, minlength=len(names))
                counts[0] = 0
                found = np.flatnonzero(counts)
                start = np.array([_word_hash(lang.encode(), 0)], _U)
                yield from self._emit(lang, None, start, np.zeros(len(found), np.int64), found, counts[found], vocabulary, dealt % _DEALT_ALL)
            if max(self.sizes) > 1:
                yield from self._phrases(lang, row, names, vocabulary, dealt % _DEALT)
        self._clear()

    def _phrases(self, lang: str, row: np.ndarray, names: list[bytes], vocabulary: pa.Array, dealt: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stripes of the phrases of two words and more."""
        seed = _word_hash(lang.encode(), 0)
        hashes = np.fromiter((_word_hash(w, seed) for w in names), _U, len(names))
        good = self.words.of(hashes)
        good[0] = False
        good = good[row]
        size = max(self.sizes)
        at = np.flatnonzero(good[:-1] & good[1:])  # where a pair of frequent words begins
        pairs, place = np.unique(row[at].astype(np.int64) * len(names) + row[at + 1], return_inverse=True)
        first, last = pairs // len(names), pairs % len(names)
        if 2 in self.sizes:
            yield from self._emit(lang, vocabulary, hashes, first, last, np.bincount(place, minlength=len(pairs)), vocabulary, dealt)
        if size == 2:
            return
        kept = self.pairs.of(_pair_hashes(hashes[first], hashes[last]))
        rank = np.full(len(row), -1, np.int64)  # of the phrase that begins at a place
        rank[at] = np.where(kept[place], place, -1)
        follows, phrases = rank >= 0, pc.binary_join_element_wise(vocabulary.take(pa.array(first)), vocabulary.take(pa.array(last)), b" ")
        named = _pair_hashes(hashes[first], hashes[last])  # of phrases
        for n in range(3, size + 1):
            at = at[(rank[at] >= 0) & follows[np.minimum(at + n - 2, len(row) - 1)]]
            keys, place = np.unique(rank[at] * len(names) + row[at + n - 1], return_inverse=True)
            before, last = keys // len(names), keys % len(names)
            yield from self._emit(lang, phrases, named, before, last, np.bincount(place, minlength=len(keys)), vocabulary, dealt)
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), vocabulary.take(pa.array(last)), b" ")
            named = _pair_hashes(named[before], hashes[last])
            rank[:] = -1
            rank[at] = place

    def _emit(self, lang, prefixes, keys, before, last, counts, vocabulary, dealt) -> Iterator[pa.RecordBatch]:
        """Stripes of entries (prefix `before`, word `last`, count), which are in the order of before; keys are hashes of the prefixes."""
        if not len(before):
            return
        part = (_pair_hashes(keys[before], dealt[last].astype(_U)) % _U(self.parts)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, before, last, counts = part[order], before[order], last[order], counts[order].astype(np.int64)
        words = vocabulary.take(pa.array(last))
        begins = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (part[1:] != part[:-1])]))  # of stripes
        stems = prefixes.take(pa.array(before[begins])) if prefixes is not None else pa.array([b""] * len(begins), pa.binary())
        sizes = np.diff(np.append(begins, len(order)))
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(order))
        stripes = np.searchsorted(begins, edges)
        packed = [_pack(stems[i:j], sizes[i:j], words[m:n], counts[m:n]) for m, n, i, j in zip(edges, edges[1:], stripes, stripes[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array([lang] * len(packed), pa.string()), pa.array(packed, pa.binary())], names=["part", "lang", "stripes"])


def _bytes(strings: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of an array of strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return np.diff(offsets).astype(np.int32).tobytes(), memoryview(strings.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _pack(stems: pa.Array, sizes: np.ndarray, words: pa.Array, counts: np.ndarray) -> bytes:
    """Stripes as one compressed value: each prefix, how many entries it has, and the entries' words and counts."""
    columns = [*_bytes(stems), sizes.astype(np.int32).tobytes(), *_bytes(words), counts.tobytes()]
    raw = np.array([len(c) for c in columns], np.int64).tobytes() + b"".join(columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(value: bytes) -> pa.Table:
    """(prefix, word, n) of packed stripes."""
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum(np.append(48, np.frombuffer(raw, np.int64, 6)))
    columns = [raw[i:j] for i, j in zip(ends, ends[1:])]
    stems = _strings(np.frombuffer(columns[0], np.int32), columns[1])
    sizes = np.frombuffer(columns[2], np.int32)
    prefix = stems.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    return pa.table([prefix, _strings(np.frombuffer(columns[3], np.int32), columns[4]), pa.array(np.frombuffer(columns[5], np.int64))], names=["prefix", "word", "n"])


def _merge(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["prefix", "word"]).aggregate([("n", "sum")]).rename_columns(["prefix", "word", "n"])


def _merged(packed: DataFrame, least: int, parts: int) -> DataFrame:
    """Stripes of one key merged elementwise; only entries of `least` or more are kept, but total is the sum of all.

    A task merges the stripes of one part; it holds that part's distinct entries and some that it has just read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        fresh = 0
        for batch in batches:
            for lang, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                table = _unpack(value.as_py())
                held.setdefault(lang, []).append(table)
                fresh += len(table)
                if fresh > _HELD:
                    held, fresh = {k: [_merge(v)] for k, v in held.items()}, 0
        for lang in list(held):
            whole = _merge(held.pop(lang))
            total = pc.sum(whole.filter(pc.equal(whole["prefix"], b""))["n"]).as_py() or 0
            kept = whole.filter(pc.greater_equal(whole["n"], least)).sort_by("prefix").combine_chunks()
            if not len(kept):
                if total:
                    yield _stripes(lang, pa.array([b""]), [0, 0], pa.array([], pa.binary()), pa.array([], pa.int64()), total)
                continue
            prefix, word, n = (kept[c].chunk(0) for c in ("prefix", "word", "n"))
            code = prefix.dictionary_encode().indices.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            yield _stripes(lang, prefix.take(pa.array(begins)), np.append(begins, len(code)), word, n, total)

    return packed.repartitionById(parts, F.col("part")).mapInArrow(run, _MERGED)


def _stripes(lang: str, prefix: pa.Array, offsets, words: pa.Array, counts: pa.Array, total: int) -> pa.RecordBatch:
    """Rows of _MERGED; total is the sum of the empty prefix's entries, and 0 for others."""
    size = [p.count(b" ") + 2 if p else 1 for p in prefix.to_pylist()]
    offsets = pa.array(offsets, pa.int32())
    totals = [total if s == 1 else 0 for s in size]
    if total and 1 not in size:
        raise AssertionError("words are counted in a pass of their own")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(size), pa.string()), pa.array(size, pa.int32()), prefix.cast(pa.string()), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(offsets, words.cast(pa.string())), pa.ListArray.from_arrays(offsets, counts)],
        names=["lang", "size", "prefix", "total", "words", "counts"],
    )


def _members(merged: DataFrame, size: int) -> np.ndarray:
    """A filter of the words (size 1) or pairs (size 2) that merged stripes have. Its bits come to the driver, MOST_BITS at most."""
    count = merged.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = 1 << max(12, min(MOST_BITS.bit_length() - 1, (count * BITS_PER_PHRASE).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, prefix, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seed = _word_hash(lang.encode(), 0)
                hashes = np.fromiter((_word_hash(w.encode(), seed) for w in words), _U, len(words))
                if size == 2:
                    hashes = _pair_hashes(np.full(len(words), _word_hash(prefix.encode(), seed), _U), hashes)
                places = np.concatenate(Members.places(hashes, bits))
                yield pa.RecordBatch.from_arrays([pa.array((places >> _U(6)).astype(np.int64)), pa.array((places & _U(63)).astype(np.int64))], names=["slot", "bit"])

    placed = merged.select("lang", "prefix", "words").mapInArrow(run, "slot long, bit long")
    slots = placed.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits")).toArrow()
    whole = np.zeros(bits // 64, np.int64)
    whole[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return whole.view(np.uint8)


def stripes(docs: DataFrame, sizes: Sequence[int], parts: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(part, lang, stripes): the stripes of phrases of the given sizes as tasks found them, those of one part packed together.

    A part has whole keys: prefix and piece of its stripe. Phrases of two words and more are counted if all their words are in the filter `words`, those of three and more if all
    their pairs are in `pairs` too. Counts are by the words themselves, not by hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sizes, parts, *(None if bits is None else Members(bits) for bits in shared.value))
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counter.add(lang.as_py(), text.as_py())
                if counter.held >= FLUSH_WORDS:
                    yield from counter.flush()
        yield from counter.flush()

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _PACKED)


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int, max_words: int, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """The merged stripes (lang, size, prefix, total, words, counts) of words, of pairs and of longer phrases, written.

    size is that of the phrases prefix + word. Of the stripes' parts of the empty prefix all are there, so that the
    totals of a language sum up to its words.
    """
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16))
    read = lambda sizes, *known: _merged(stripes(docs, sizes, parts, *known, text_col=text_col, lang_col=lang_col), min_count, parts)
    levels = [scratch.write(read([1]), "words")]
    if max_words > 1:
        words = _members(levels[0], 1)
        levels.append(scratch.write(read([2], words), "pairs"))
    if max_words > 2:
        levels.append(scratch.write(read(list(range(3, max_words + 1)), words, _members(levels[1], 2)), "phrases"))
    return levels


def collocations(
    docs: DataFrame,
    min_count: int = 30,
    max_words: int = 4,
    subsumed_percent: int = 80,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_words words.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and 0x0A-0x0D into pieces, and those into words at spaces and tabs. a is
    the phrase's frequency, min_count at least; l and r are those of the two parts of its worst cut, n the words of the language, score is
    floor(2000000 a / (l + r)). A phrase goes if a longer one that has it occurs subsumed_percent of its times. Ranks are by
    score and a, descending, and phrase in byte order; top is the report's length.

    A null text is empty, a null language is `und`. Repeated rows count each. Texts without words, and an empty table, give no
    rows. Other columns, whatever their names, are ignored. A long text is read in blocks; a task holds FLUSH_WORDS words and
    its longest text. The stripe of a common prefix is dealt in parts by its following words.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    levels = frequent_phrases(docs, scratch, min_count, max_words, text_col, lang_col)
    totals = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    entry = whole.select("lang", "size", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.words")).otherwise(F.concat_ws(" ", "prefix", "e.words"))
    known = scratch.last(entry.select("lang", "size", phrase.alias("phrase"), F.col("e.counts").alias("a"), "prefix").join(totals, "lang"), "known")

    parts = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice(parts, first, size), " ")
    size = F.col("size")
    longer = known.where(size > 2).select("lang", F.explode(F.array("prefix", part(F.lit(2), size - 1))).alias("phrase"), F.col("a").alias("_longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(7,0)")
    free = F.col("_longer").isNull() | (exact("_longer", 100) < exact("a", subsumed_percent))
    left = known.where(size > 1).join(longer, ["lang", "phrase"], "left").where(free)

    cuts = left.select("lang", "size", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("_k"))
    cuts = cuts.withColumns({"_l": part(F.lit(1), F.col("_k")), "_r": part(F.col("_k") + 1, size - F.col("_k"))})
    f = lambda name, at: known.select("lang", F.col("phrase").alias(at), F.col("a").alias(name))
    cuts = cuts.join(f("l", "_l"), ["lang", "_l"]).join(f("r", "_r"), ["lang", "_r"])
    sums = F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")
    cuts = cuts.withColumn("_scaled", exact("a", 2_000_000)).withColumn("_sum", sums).withColumn("score", F.expr("_scaled div _sum"))
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "_k")).alias("_cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
spans AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM words, sizes WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
inside AS (
  SELECT c.lang, c.a, s.size AS part_size, array_to_string(c.w[p.i : p.i + s.size - 1], ' ') AS phrase
  FROM candidates c, sizes s, (SELECT unnest([1, 2, 3]) AS i) p WHERE s.size BETWEEN 2 AND c.size - 1 AND p.i + s.size - 1 <= c.size
),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
free AS (SELECT c.* FROM candidates c LEFT JOIN longest x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer::HUGEINT < 80 * c.a::HUGEINT),
cuts AS (SELECT lang, phrase, a, size, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : size], ' ') AS rp FROM free, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT // (x.a + y.a)::HUGEINT)::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
