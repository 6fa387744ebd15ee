"""Passages that documents share, exactly or nearly, by collinear chaining of k-mer seeds.

Seeds are the minimizers of each text's word k-mers, so that any K + WINDOW - 1 equal words share one, and as WINDOW is
less than K, the seeds of equal words leave no gap. The documents of a seed are not paired with one another: each is
matched with the first of them, its anchor, and with the one before it, so that there are at most two matches a seed.
The matches of two documents are chained in the order of both, with gap costs, through a Fenwick tree; chains are aligned between their seeds and extended at their ends. What the aligned chains of a document cover,
with whatever anchors, is joined into passages, so that a passage is found whole even if its parts have other anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.line_dedup import edit_distance
from tessera.llm.scratch import Scratch
from tessera.llm.words import BASE, hashed_texts

K, WINDOW = 5, 4
#: Passages of fewer words are not reported; aligned chains must be as similar as this.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Matches of a chain: a passage of MIN_WORDS words has some eighteen, one with every fifth word changed at random seven.
MIN_SEEDS = 2
#: Cost of a gap per word of either text, in seeds; a chain breaks where a gap costs more than a seed gains.
_GAP = 1 / 160
#: Words next to a chain into which it may be extended, and uncovered words that a passage may bridge.
_REACH, _BRIDGE = 40, 3
#: Different words between two seeds, beyond which a chain may be cut.
_CUT = 8
#: Chains of one document whose words are fetched together.
_REQUESTS = 128
#: One row of so many is read for the hashes that are very common: these have _COMMON seeds there or more. Their rows
#: are dealt in so many parts.
_SAMPLE, _COMMON, _PARTS = 32, 20, 64

#: Characters of texts whose words are hashed at once.
_PASS = 1 << 19

_P, _NONE = np.uint64(BASE), np.uint64((1 << 64) - 1)


def minimizers(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places in them and hashes of the k-mers that are the least of some window of k-mers of their text.

    words are those of all texts, one after the other; counts says how many each has. A text of fewer k-mers than a
    window has is one window.
    """
    total = len(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    mers = np.zeros(total, np.uint64)
    for j in range(K):
        mers[: total - j] = mers[: total - j] * _P + words[j:]
    mers = np.minimum(mers ^ (mers >> np.uint64(29)), _NONE - np.uint64(1))
    at = np.arange(total)
    of = at - begins[owner]
    number = np.maximum(counts - K + 1, 0)[owner]  # of k-mers of the text
    padded = np.append(np.where(of < number, mers, _NONE), np.full(WINDOW, _NONE))
    least, best = at.copy(), padded[:total].copy()
    for j in range(1, WINDOW):
        lower = padded[j : total + j] < best
        lower &= of + j < number
        least[lower] = at[lower] + j
        best[lower] = padded[j : total + j][lower]
    chosen = np.unique(least[(of < number) & ((of + WINDOW <= number) | (of == 0))])
    return owner[chosen], of[chosen], mers[chosen]


def occurrences(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, how often its text has it before; seeds are in the order of texts and places."""
    key = text.astype(np.uint64) << np.uint64(44) ^ hashes >> np.uint64(20)
    order = np.argsort(key)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    twice = np.unique(np.concatenate([order[again], order[again + 1]]))  # few: only these are told apart by their places
    order = twice[np.lexsort((twice, hashes[twice], text[twice]))]
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
    at = np.arange(len(order))
    found = np.zeros(len(hashes), np.int64)
    found[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return found


def seed_table(rows: DataFrame) -> DataFrame:
    """(row, hash, spot) for each minimizer of (row, text); spot is its place, and 2 ** 32 times how often the text has
    it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part, size = [], 0
                while start + len(part) < batch.num_rows and size < _PASS:
                    part.append(batch.column(1)[start + len(part)].as_py())
                    size += len(part[-1] or "")
                text, pos, hashes = minimizers(*hashed_texts(part))
                spot = occurrences(text, hashes) << 32 | pos
                row = batch.column(0).slice(start, len(part)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([row, pa.array(hashes.view(np.int64)), pa.array(spot)], names=["row", "hash", "spot"])
                start += len(part)

    return rows.select("row", "text").mapInArrow(run, "row long, hash long, spot long")


def _partners(key: np.ndarray, row: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each seed, the number of its partner in the first and in the last row before its own of those with its key.

    -1 where there is none, and for the second where it is the first. Seeds are sorted by key, row, nth. The n-th of
    equal seeds of a row is matched with the n-th of its partner's, or the last if that has fewer.
    """
    at = np.arange(len(key))
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    new_row = new_key | np.append(True, row[1:] != row[:-1])[: len(key)]
    starts = np.flatnonzero(new_row)
    run = np.cumsum(new_row) - 1
    size = np.diff(np.append(starts, len(key)))
    first = run[np.maximum.accumulate(np.where(new_key, at, 0))]
    place = lambda of: starts[of] + np.minimum(nth, size[of] - 1)
    return np.where(run == first, -1, place(first)), np.where(run <= first + 1, -1, place(run - 1))


def matches(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, anchor, x, y): each seed that several of rows have, matched with its places in the least and the last before.

    Rows of a very common hash are dealt by their number, and their first ones are matched in a second pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the seeds of the last key in its first row and its last two, which later ones are matched with
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            old = 0 if held is None else len(held[0])
            h, part, row, spot = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            key = h ^ part * 0x9E3779B1
            one, two = _partners(key, row, spot >> 32)
            found = [(np.flatnonzero(to[old:] >= 0) + old, to) for to in (one, two)]
            again = np.flatnonzero((one[old:] < 0) & (part[old:] >= 0)) + old
            who = np.concatenate([*(f for f, _ in found), again])
            to = np.concatenate([*(t[f] for f, t in found), again])
            mark = np.arange(len(who)) >= len(who) - len(again)
            places = ((spot[i] & 0xFFFFFFFF).astype(np.int32) for i in (who, to))
            columns = [row[who], row[to], *places, np.where(mark, h[who], 0), np.where(mark, spot[who], 0), mark]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "anchor", "x", "y", "hash", "spot", "again"])
            last = np.flatnonzero(key == key[-1])
            keep = last[np.isin(row[last], [row[last[0]], *np.unique(row[last])[-2:]])]
            held = [c[keep] for c in (h, part, row, spot)]

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.select("hash", "part", "row", "spot").repartition("hash", "part").sortWithinPartitions("hash", "part", "row", "spot")
        return rows.mapInArrow(run, "row long, anchor long, x int, y int, hash long, spot long, again boolean")

    seeds, sample = seed_table(rows), seed_table(rows.where(F.pmod(F.xxhash64("row"), F.lit(_SAMPLE)) == 0))
    common = scratch.write(sample.groupBy("hash").count(), "sample")
    least = max(_COMMON, (common.agg(F.sum("count")).first()[0] or 0) / 10_000)  # so that at most 10,000 are broadcast
    common = F.broadcast(common.where(F.col("count") >= least).select("hash", F.lit(1).alias("hot")))
    # Seeds of other hashes have part -1.
    part = F.when(F.col("hot") == 1, F.pmod(F.xxhash64("row"), F.lit(_PARTS))).otherwise(F.lit(-1)).cast("long")
    found = scratch.write(dealt(seeds.join(common, "hash", "left").withColumn("part", part)), "matches")
    firsts = found.where("again").select("hash", F.lit(-1).cast("long").alias("part"), "row", "spot")
    columns = ["row", "anchor", "x", "y"]
    return found.where("not again").select(columns).unionByName(dealt(firsts).select(columns))


def chain(x: list[int], y: list[int]) -> list[list[int]]:
    """Disjoint chains of matches, as lists of their numbers in order; matches are sorted by x, then y.

    A chain's score is its matches less _GAP for each word between them in either text. That cost is a sum of terms
    of the two ends, so the best predecessor of a match is a prefix maximum over y: one look-up in a Fenwick tree.
    """
    steps = [(b - a, d - c) for a, b, c, d in zip(x, x[1:], y, y[1:])]
    if all(i > 0 and j > 0 and _GAP * (i + j) < 1 for i, j in steps):
        return [list(range(len(x)))]  # each match gains by following the one before
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(ranks) + 1
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * size
    score, before = [1.0] * len(x), [-1] * len(x)
    start = 0
    while start < len(x):
        end = start
        while end < len(x) and x[end] == x[start]:
            end += 1
        for j in range(start, end):  # matches of one x don't follow one another
            best, at = (float("-inf"), -1), ranks[y[j]] - 1
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            gain = best[0] - _GAP * (x[j] + y[j])
            if best[1] >= 0 and gain > 0:
                score[j], before[j] = 1 + gain, best[1]
        for j in range(start, end):
            entry, at = (score[j] + _GAP * (x[j] + y[j]), j), ranks[y[j]]
            while at < size:
                tree[at] = max(tree[at], entry)
                at += at & -at
        start = end
    chains, used = [], [False] * len(x)
    for j in sorted(range(len(x)), key=lambda j: -score[j]):
        found = []
        while j >= 0 and not used[j]:
            used[j] = True
            found.append(j)
            j = before[j]
        if found:
            chains.append(found[::-1])
    return chains


def chains_of(found: DataFrame) -> DataFrame:
    """(row, anchor, number, xs, ys): the chains of each pair of rows with MIN_SEEDS matches or more."""
    names = ["row", "anchor", "number", "xs", "ys"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def chained(columns: list[np.ndarray]) -> pa.RecordBatch:
        row, anchor, x, y = columns
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))) if len(row) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(row))[: len(starts)]
        out: list[tuple] = []
        for a, b in zip(starts[ends - starts >= MIN_SEEDS].tolist(), ends[ends - starts >= MIN_SEEDS].tolist()):
            xs, ys = x[a:b].tolist(), y[a:b].tolist()
            kept = [c for c in chain(xs, ys) if len(c) >= MIN_SEEDS]
            out += [(row[a], anchor[a], number, [xs[i] for i in c], [ys[i] for i in c]) for number, c in enumerate(kept)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)] * 2  # the matches of the last pair, which may go on
        for batch in batches:
            if batch.num_rows:
                rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
                other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                yield chained([c[:last] for c in rows])
                held = [c[last:] for c in rows]
        yield chained(held)

    dealt = found.repartition("row", "anchor").sortWithinPartitions("row", "anchor", "x", "y")
    return dealt.select("row", "anchor", "x", "y").mapInArrow(run, "row long, anchor long, number int, xs array<int>, ys array<int>")


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """Words by which equal beginnings of a and b reach: a mismatch costs two matches, and six of them end it."""
    n = min(len(a), len(b))
    if not n:
        return 0
    gains = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    stop = np.flatnonzero(np.maximum.accumulate(np.maximum(gains, 0)) - gains > 6)
    gains = gains[: stop[0]] if len(stop) else gains
    return int(gains.argmax()) + 1 if len(gains) and gains.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, x0: int, y0: int, xs: list[int], ys: list[int], least: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Spans of the two texts and their similarity, for a chain; a and b are words from places x0 and y0 on.

    Where the words between two seeds have little in common, the chain is cut, so that they don't spoil its ends. What
    is less similar than `least` is cut at every difference between seeds, so that its equal words stay.
    """
    parts, start, distance, cuts = [], 0, 0, []
    equal = np.array_equal(a[xs[0] - x0 : xs[-1] - x0], b[ys[0] - y0 : ys[-1] - y0])
    for i in range(0 if equal else len(xs) - 1):
        one, two = a[xs[i] - x0 : xs[i + 1] - x0], b[ys[i] - y0 : ys[i + 1] - y0]
        between = 0 if np.array_equal(one, two) else edit_distance(one.tolist(), two.tolist())
        if between:
            cuts.append(i)
        if between > max(_CUT, max(len(one), len(two)) / 3):
            parts.append((start, i, distance))
            start, distance = i + 1, 0
        else:
            distance += between
    parts.append((start, len(xs) - 1, distance))
    spans = []

    def add(first: int, last: int, distance: int) -> None:
        right = _extend(a[xs[last] - x0 + K :], b[ys[last] - y0 + K :])
        left = _extend(a[: xs[first] - x0][::-1], b[: ys[first] - y0][::-1])
        ends = (xs[first] - left, xs[last] + K + right, ys[first] - left, ys[last] + K + right)
        found = 1 - distance / max(ends[1] - ends[0], ends[3] - ends[2])
        if found >= least or not distance:
            spans.append((*ends, found))
            return
        for i in [*(c for c in cuts if first <= c < last), last]:
            add(first, i, 0)
            first = i + 1

    for part in parts:
        add(*part)
    return spans


def _requests(chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(of, asks): lists of the places around chains whose words are wanted of a row, on either side of a chain."""
    ask = lambda side, place, row: chains.select(
        F.col(row).alias("of"),
        F.struct(
            "row", "anchor", "number", F.lit(side).alias("side"),
            F.greatest(F.element_at(place, 1) - _REACH, F.lit(0)).alias("start"), (F.element_at(place, -1) + K + _REACH).alias("end"),
        ).alias("ask"),
    )
    asks = ask(0, "xs", "row").unionByName(ask(1, "ys", "anchor"))
    # A row that anchors many chains is asked for in several lists, dealt by the chains' hashes.
    many = asks.groupBy("of").agg(F.ceil(F.count("*") / _REQUESTS).cast("int").alias("lists")).where("lists > 1")
    many = scratch.write(many, "many")  # so that the join can split the requests to one row
    dealt = asks.join(many, "of", "left").withColumn("list", F.pmod(F.xxhash64("ask.row", "ask.number"), F.coalesce("lists", F.lit(1))))
    lists = dealt.groupBy("of", "list").agg(F.collect_list("ask").alias("asks"))
    return lists.select("of", "asks")


def _fetch(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, anchor, number, side, start, words): the 32-bit word hashes that are asked for."""
    names = ["row", "anchor", "number", "side", "start"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for text, asks in zip(batch.column(0), batch.column(1)):
                words = hashed_texts([text.as_py()])[0].astype(np.uint32)
                for ask in asks.as_py():
                    part = words[ask["start"] : ask["end"]].tobytes()
                    out.append((*(ask[n] for n in names), part))
                    size += len(part)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*names, "words"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*names, "words"])

    joined = rows.join(lists.hint("merge"), F.col("row") == F.col("of")).select("text", "asks")
    return joined.mapInArrow(run, "row long, anchor long, number int, side int, start int, words binary")


def aligned(rows: DataFrame, chains: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(row, anchor, x_start, x_end, y_start, y_end, similarity) of the chains that are similar enough; in words."""
    parts = scratch.write(_fetch(rows, scratch.write(_requests(chains, scratch), "asks")), "words")
    keys = ["row", "anchor", "number"]
    one = parts.where("side = 0").select(*keys, F.col("start").alias("x0"), F.col("words").alias("a"))
    two = parts.where("side = 1").select(*keys, F.col("start").alias("y0"), F.col("words").alias("b"))
    whole = chains.join(one, keys).join(two, keys).select("row", "anchor", "xs", "ys", "x0", "y0", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = [], []
            for i, (xs, ys, x0, y0, a, b) in enumerate(zip(*batch.columns[2:])):
                words = [np.frombuffer(w.as_py(), np.uint32) for w in (a, b)]
                spans = align(*words, x0.as_py(), y0.as_py(), xs.as_py(), ys.as_py(), similarity)
                ends += spans
                at += [i] * len(spans)
            columns = list(zip(*ends)) if ends else [[]] * 5
            rows = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(2)]
            arrays = [*rows, *(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "anchor", "x_start", "x_end", "y_start", "y_end", "similarity"])

    schema = "row long, anchor long, x_start int, x_end int, y_start int, y_end int, similarity double"
    return whole.mapInArrow(run, schema).where(F.col("similarity") >= similarity)


def passages(spans: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, start_word, end_word, n_words, partner, original): what spans cover, joined where they meet."""
    sides = spans.select("row", F.col("x_start").alias("start"), F.col("x_end").alias("end"), F.col("anchor").alias("partner"), F.lit(False).alias("original"))
    other = spans.select(F.col("anchor").alias("row"), F.col("y_start").alias("start"), F.col("y_end").alias("end"), F.col("row").alias("partner"), F.lit(True).alias("original"))
    # Spans of one place come first to one row, for the first copy of a passage has one for each other copy.
    spots = sides.unionByName(other).groupBy("row", "start", "end").agg(F.min("partner").alias("partner"), F.min("original").alias("original"))
    earlier = "max(end) over (partition by row order by start, end rows between unbounded preceding and 1 preceding)"
    islands = spots.selectExpr("*", f"coalesce(start > {earlier} + {_BRIDGE}, true) as fresh")
    islands = islands.selectExpr("*", "sum(int(fresh)) over (partition by row order by start, end) as island")
    joined = islands.groupBy("row", "island").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("partner").alias("partner"), F.min("original").alias("original")
    )
    return joined.withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= min_words)


def substring_dedup(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage: id_col, start_word, end_word, n_words, partner_id, original.

    A passage is min_words or more words of a row that other rows have too. Words are runs of characters other than
    space and 0x09-0x0D, numbered from 0, end_word excluded, and A-Z count as a-z. partner_id is the id of one row that
    shares (part of) it; original says that no part of it repeats a row with a lesser id, so that dropping the other
    passages keeps one copy. Repeats within one text alone are not reported. A null text has no words; null and
    repeated ids are kept: such rows are told apart by their texts, and rows that are equal in both by a number. Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = scratch.ordered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "row")
    ids = rows.select("row", "id")
    chains = scratch.write(chains_of(matches(rows, scratch)), "chains")
    found = scratch.last(passages(aligned(rows, chains, scratch, similarity), min_words), "passages")
    partners = ids.select(F.col("row").alias("partner"), F.col("id").alias("partner_id"))
    return found.join(ids, "row").join(partners, "partner").select(F.col("id").alias(id_col), "start_word", "end_word", "n_words", "partner_id", "original")


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
