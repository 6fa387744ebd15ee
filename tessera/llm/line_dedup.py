"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one occurrence of each connected group.

Lines are normalised, and equal ones collapse to one. Two of the others are compared if they agree in a whole block of
their fingerprints (line_prints.py) and in the 16-bit tags of one or two others: a feature that differs touches one
block, so long lines that differ in up to BLOCKS - 2 features, three words say, always are. Lines are dealt by one block at a time; a block
value with many lines is dealt again by the tags of the other blocks, and where that leaves many, by pairs of tiles.
Lines with a neighbour form sets, equal sets of several blocks collapse, and only then are their texts fetched and
compared by edit similarity; a pair of lines that others of the set connect already is not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.line_prints import BLOCKS, NEED, lines_of_texts, normalise
from tessera.llm.scratch import Scratch
from tessera.llm.words import mix

SIMILARITY = 0.8
#: Lines of one block value that are compared at once; of one block value and tag; more are dealt further.
_RUN, _TILE = 4096, 2048
#: One line of so many is read for the block values that are very common, those of _COMMON lines there or more.
_SAMPLE, _COMMON = 32, 512
#: Candidate lines up to this number (some 20 bytes each) are broadcast to fetch their texts; more are joined by a shuffle.
_BROADCAST_LINES = 500_000


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, a row of the table at a time as the bits of a whole number; a number over `most` if it is."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, score = full, 0, len(b)
    for left, c in zip(range(len(a) - 1, -1, -1), a):
        equal = where.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = (down | ~(diagonal | up)) & full
        right_down = up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        if score - left > most:  # it falls by one for each character that is left, at most
            return score
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up = (right_down | ~(diagonal | right_up)) & full
        down = right_up & diagonal
    return score


def _same_start(a: str, b: str) -> int:
    """Characters of the common beginning, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _surplus(a: str, b: str) -> int:
    """Characters of the longer text, in any order, that the other lacks: the edit distance is no less."""
    if len(a) < len(b):
        a, b = b, a
    return sum(max(a.count(c) - b.count(c), 0) for c in set(a))


#: Steps past a difference, in words of either side, the shortest first.
_STEPS = sorted(((i, j) for i in range(5) for j in range(5) if i + j), key=lambda s: (sum(s), abs(s[0] - s[1])))


def _replaced(a: list[str], b: list[str], most: float) -> int:
    """Characters of the words that differ where both lists are read side by side: at least the edit distance of the
    texts. Stops beyond `most`."""
    i, j, cost = 0, 0, 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        di, dj = next(((di, dj) for di, dj in _STEPS if i + di < len(a) and j + dj < len(b) and a[i + di] == b[j + dj]), (1, 1))
        cost += max(sum(map(len, a[i : i + di])) + di, sum(map(len, b[j : j + dj])) + dj)
        i, j = i + di, j + dj
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j)


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - distance / longer length is at least similarity."""
    most = (1 - similarity) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    if _replaced(a.split(" "), b.split(" "), most) <= most:
        return True  # the distance is no more than that
    start = _same_start(a, b)
    a, b = a[start:][::-1], b[start:][::-1]
    end = _same_start(a, b)
    a, b = a[end:], b[end:]
    return max(len(a), len(b)) <= most or (_surplus(a, b) <= most and edit_distance(a, b, most) <= most)


def line_table(rows: DataFrame) -> DataFrame:
    """(row, line, key, key2, kind, again, p0, ..., q0, ...) for each line of (row, text) with a letter or digit.

    line is its place, key and key2 a 128-bit hash of the normalised line, kind the kind of its fingerprint and p0, ... the blocks, two to a
    number. q0, ... are those of the second fingerprint, of the next kind, that some lines have. again marks that the text has an equal
    line before.
    """
    names = ["row", "line", *_KEY, "kind", "again", *_P, *_Q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, seen = None, set()
            for rows, places, found in lines_of_texts(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                again = np.zeros(len(rows), bool)
                for i, (row, key) in enumerate(zip(rows.tolist(), found.key)):
                    if row != last:
                        last, seen = row, set()
                    again[i] = key in seen
                    seen.add(key)
                keys = np.frombuffer(b"".join(found.key), "<i8").reshape(-1, 2)
                more, none = np.zeros((len(rows), len(_Q)), np.int64), np.ones(len(rows), bool)
                more[found.more], none[found.more] = found.more_prints.view("<i8"), False
                packed = [pa.array(np.ascontiguousarray(c)) for c in (*keys.T, found.kind.astype(np.int32), again, *found.prints.view("<i8").T)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(places.astype(np.int32)), *packed, *(pa.array(c, mask=none) for c in more.T)], names=names)

    schema = "row long, line int, key long, key2 long, kind int, again boolean, " + ", ".join(f"{p} long" for p in (*_P, *_Q))
    return rows.select("row", "text").mapInArrow(run, schema)


_KEY = ["key", "key2"]
_P, _Q = ([f"{name}{i}" for i in range(BLOCKS // 2)] for name in "pq")
_ROW = ["key", "node", "low", "high"]
_MIX = 0x1E3779B1


def _fingerprints(distinct: DataFrame) -> DataFrame:
    """(node, kind, p0, ...) for each fingerprint of the lines, first and second."""
    second = [F.col(q).alias(p) for p, q in zip(_P, _Q)]
    return distinct.select("node", "kind", *_P).unionByName(distinct.where(F.col(_Q[0]).isNotNull()).select("node", (F.col("kind") + 1).alias("kind"), *second))


def _dealt(prints: DataFrame) -> DataFrame:
    """(key, node, low, high): a row for each block of a line but the last ones, for of NEED equal blocks one is among the others.

    The low five bits of the key are the kind and the number of the block. low and high are the 16-bit tags of four blocks each; a
    block without features has the tag 0.
    """
    blocks = [F.shiftrightunsigned(p, 32) if half else F.col(p).bitwiseAND(F.lit(0xFFFFFFFF)) for p in _P for half in (0, 1)]
    tag = lambda b, i: F.shiftleft(F.shiftright(b * F.lit(_MIX), 16).bitwiseAND(F.lit(65535)), 16 * i)
    low, high = (reduce(lambda a, b: a.bitwiseOR(b), (tag(b, i) for i, b in enumerate(part))) for part in (blocks[:4], blocks[4:]))
    needed = F.element_at(F.array(*map(F.lit, NEED)), F.col("kind") + 1)
    keys = F.array(*[F.when((b != 0) & (needed <= BLOCKS - i), F.shiftleft(b, 5) + F.col("kind") * 8 + F.lit(i)) for i, b in enumerate(blocks[: BLOCKS + 1 - min(NEED)])])
    return prints.select("node", low.alias("low"), high.alias("high"), F.explode(keys).alias("key")).where("key is not null").select(*_ROW)


_NEED = np.array(NEED)


def _agree(key: np.ndarray, one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Whether tags, (low, high), agree in as many blocks as the keys' kind needs."""
    equal = (((a ^ b).view(np.uint16) == 0).view(np.uint32) for a, b in zip(one, other))  # four tags' 0 or 1
    return sum(np.bitwise_count(e) for e in equal) >= _NEED[key >> 3 & 3]


def _flagged(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows have another that agrees in their run of equal keys; each is compared with the next, the one after..."""
    found, at, step = np.zeros(len(key), bool), np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return found
        near = at[_agree(key[at], [low[at], high[at]], [low[at + step], high[at + step]])]
        found[near] = found[near + step] = True
        step += 1


def _sets(dealt: DataFrame, most: int | None) -> DataFrame:
    """(set, home, key, node, low, high): the lines of each key that agree with another of it, and the name of their set.

    Sets of the same lines have the same name. home is the least line of a set: sets of one home, of which there are no
    more than blocks, are compared one after the other. Without `most` it is the name of the set. The rows of a key with more than `most` lines are returned as they are,
    without a set.
    """

    def compared(key: np.ndarray, node: np.ndarray, *tags: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(_flagged(key, *tags))
        name, home = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(at):
            starts = np.flatnonzero(np.append(True, key[at[1:]] != key[at[:-1]]))
            sums = np.add.reduceat(mix(node[at].astype(np.uint64)), starts) + (key[at[starts]] & 24).astype(np.uint64)
            sizes = np.diff(np.append(starts, len(at)))
            name = np.repeat(mix(sums), sizes)
            home = np.repeat(np.minimum.reduceat(node[at], starts), sizes) if most else name.view(np.int64)
        return rows_of(pa.array(name.view(np.int64)), pa.array(home), *(c[at] for c in (key, node, *tags)))

    def rows_of(name: pa.Array, home: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([name, home, *map(pa.array, columns)], names=["set", "home", *_ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.zeros(0, np.int64)] * 4, None  # the rows of the last key, which may go on, and the last large key
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            rows = [np.concatenate(c) for c in zip(held, new)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            sizes = np.diff(np.append(starts, len(rows[0])))
            big = (sizes > most) | (rows[0][starts] == large) if most else np.zeros(len(starts), bool)
            whole, open_run = np.repeat(big, sizes), np.arange(len(rows[0])) >= starts[-1]
            if whole.any():
                yield rows_of(*[pa.nulls(int(whole.sum()), pa.int64())] * 2, *(c[whole] for c in rows))
                large = rows[0][whole][-1]
            yield compared(*(c[~whole & ~open_run] for c in rows))
            held = [c[~whole & open_run] for c in rows]
        yield compared(*held)

    schema = "set long, home long, key long, node long, low long, high long"
    return dealt.select(*_ROW).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)  # by one number alone, which is a radix sort


def _subkey(*of: Column | str) -> Column:
    """A hash of the key and more, with the key's low bits."""
    return F.shiftleft(F.xxhash64("key", *of), 5).bitwiseOR(F.col("key").bitwiseAND(F.lit(31)))


def candidate_sets(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(set, home, key, node, low, high): the lines (node, kind, p0, ...) that agree with another, in sets of lines of one block value."""
    sample = _dealt(prints.where(F.pmod(F.xxhash64("node"), F.lit(_SAMPLE)) == 0)).groupBy("key").count().where(F.col("count") >= _COMMON)
    common = scratch.write(sample.select(F.col("key").alias("common")), "common")  # (BLOCKS - 1) / _COMMON of the sample's lines at most
    rows = _dealt(prints)
    if some := common.limit(1).count():
        common = F.broadcast(common) if common.count() <= _BROADCAST_LINES else common
        few = rows.join(common, F.col("key") == F.col("common"), "left_anti")
    found = scratch.write(_sets(few if some else rows, _RUN), "candidates")
    again = found.where("set is null").select(*_ROW)
    again = again.unionByName(rows.join(common, F.col("key") == F.col("common"), "left_semi")) if some else again
    parts = [found.where("set is not null")]
    if again.limit(1).count():
        tag = F.expr("shiftright(if(other < 4, low, high), 16 * (other & 3)) & 65535")
        others = F.filter(F.array(*map(F.lit, range(BLOCKS))), lambda i: i != F.col("key").bitwiseAND(F.lit(7)))
        finer = again.withColumn("other", F.explode(others)).select(_subkey("other", tag).alias("key"), *_ROW[1:])
        finer = scratch.write(finer, "finer")
        # A plain join with what is there more than _TILE times, which Spark splits where one key has many rows.
        large = finer.groupBy("key").count().where(F.col("count") > _TILE).select("key", F.ceil(F.col("count") / _TILE).cast("int").alias("parts"))
        large = scratch.write(large, "large")
        if large.limit(1).count():
            tiled = finer.join(large, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
            tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            tiled = tiled.select(_subkey(F.least("part", "other"), F.greatest("part", "other")).alias("key"), *_ROW[1:])
            parts.append(scratch.write(_sets(tiled, None), "tiled"))
            finer = finer.join(large, "key", "left_anti")
        parts.append(scratch.write(_sets(finer, None), "small"))
    # The key has no more to tell than the kind, so that sets which several blocks have collapse.
    kind = F.col("key").bitwiseAND(F.lit(24)).alias("key")
    return reduce(DataFrame.unionByName, (p.select("set", "home", kind, *_ROW[1:]) for p in parts)).distinct()


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): the normalised text of the lines in wanted (node, row, line)."""
    few = wanted.count() <= _BROADCAST_LINES
    lists = wanted.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("line", "node")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts, size = [], [], 0
            for text, lines in zip(batch.column(0), batch.column(1)):
                parts = text.as_py().split("\n")
                for x in lines.as_py():
                    nodes.append(x["node"])
                    texts.append(normalise(parts[x["line"]]))
                    size += len(texts[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])
                    nodes, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])

    joined = rows.join(F.broadcast(lists) if few else lists, F.col("row") == F.col("of")).select("text", "lines")
    return joined.mapInArrow(run, "node long, text string")


def _root(parent: dict[int, int], node: int) -> int:
    while (up := parent.get(node, node)) != node:
        parent[node] = parent.get(up, up)
        node = up
    return node


def _links(parent: dict[int, int], key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[str], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between similar lines of a set that no earlier link connects; parent has those of the sets before."""
    nodes = node.tolist()
    roots = [_root(parent, n) for n in nodes]
    if len(nodes) == 2:  # they agree, else there were no set
        if roots[0] != roots[1] and similar(*texts, similarity):
            parent[roots[1]] = roots[0]
            yield nodes[0], nodes[1]
        return
    label = np.unique(roots, return_inverse=True)[1]
    for i in range(len(nodes) - 1):
        near = _agree(key[i + 1 :], [low[i], high[i]], [low[i + 1 :], high[i + 1 :]]) & (label[i + 1 :] != label[i])
        for j in np.flatnonzero(near) + i + 1:
            if label[i] != label[j] and similar(texts[i], texts[j], similarity):
                label[label == label[j]] = label[i]
                parent[_root(parent, nodes[j])] = _root(parent, nodes[i])
                yield nodes[i], nodes[j]


def similar_pairs(sets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links that connect all similar lines of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [np.zeros(0, np.int64)] * 6, []  # the rows of the last set, which may go on
        parent, last_home = {}, None

        def linked(columns: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
            nonlocal parent, last_home
            home, name, *rest = columns
            fresh = np.append(True, (name[1:] != name[:-1]) | (home[1:] != home[:-1])) if len(texts) else np.zeros(0, bool)
            starts, found = np.append(np.flatnonzero(fresh), len(texts)).tolist(), []
            for a, b in zip(starts, starts[1:]):
                if home[a] != last_home:
                    parent, last_home = {}, home[a]
                if b - a > 1:
                    found += _links(parent, *(c[a:b] for c in rest), texts[a:b], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["src", "dst"])

        for batch in batches:
            if batch.num_rows:
                rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
                texts += batch.column(6).to_pylist()
                other = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[0] != rows[0][-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                yield linked([c[:last] for c in rows], texts[:last])
                held, texts = [c[last:] for c in rows], texts[last:]
        yield linked(held, texts)

    whole = sets.join(texts, "node").select("home", "set", *_ROW, "text")
    return whole.repartition("home").sortWithinPartitions("home", "set", "key", "node").mapInArrow(run, "src long, dst long").distinct()


def _fuzzy_groups(rows: DataFrame, distinct: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root, key, key2, row, line) of the distinct lines that are similar to another, directly or by others."""
    sets = scratch.write(candidate_sets(_fingerprints(distinct), scratch), "sets")
    close = scratch.write(sets.select("node").distinct(), "close")
    wanted = scratch.write(distinct.select("node", *_KEY, "row", "line").join(close, "node", "left_semi"), "wanted")
    texts = scratch.write(_texts(rows, wanted), "texts")
    return wanted.join(connected_components(similar_pairs(sets, texts, similarity), scratch), "node")


def dropped_lines(rows: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(row, dropped): for each row of (row, text) that loses lines, their places; rows with lesser numbers keep theirs."""
    lines = scratch.write(line_table(rows), "lines")
    first = F.when(~F.col("again"), F.col("row"))
    prints = [F.max(p).alias(p) for p in ("kind", *_P, *_Q)]
    distinct = lines.groupBy(*_KEY).agg(F.min(first).alias("row"), F.min_by("line", first).alias("line"), F.count("*").alias("n"), *prints)
    distinct = scratch.write(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    grouped = scratch.write(_fuzzy_groups(rows, distinct, similarity, scratch), "grouped")
    of_root = grouped.groupBy("root").agg(F.min(F.struct("row", "line")).alias("kept"))
    kept = grouped.join(of_root, "root").select(*_KEY, F.col("kept.row").alias("kept_row"), F.col("kept.line").alias("kept_line"))
    # A line that is similar to no other is of interest only if it has copies.
    copied = distinct.where("n > 1").join(grouped.select("node"), "node", "left_anti").select(*_KEY, F.col("row").alias("kept_row"), F.col("line").alias("kept_line"))
    kept = scratch.write(kept.unionByName(copied), "kept")
    gone = lines.select("row", "line", *_KEY).join(kept, _KEY).where("row != kept_row or line != kept_line")
    return gone.groupBy("row").agg(F.collect_list("line").alias("dropped"))


def line_dedup(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """docs with its text without the lines that repeat an earlier one, and the column n_dropped.

    Lines are what \\n separates. A line without letters and digits stays. Of each connected group of similar lines,
    the first occurrence stays: in the text with the least id, of equal ids that with the least hash of the row; rows
    without an id come last. One row per row of docs, also where no line is left (the text is then empty) and where the text is
    null (it stays null, n_dropped is 0). A column named n_dropped is replaced; other columns are kept as they are.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.drop("n_dropped")
    whole = scratch.ordered(docs, id_col, "_row")
    rows = whole.select(F.col("_row").alias("row"), F.col(text_col).alias("text")).where("text is not null")
    gone = scratch.last(dropped_lines(rows, scratch, similarity), "dropped").withColumnRenamed("row", "_gone")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    # Both sides are dealt by the row number at every size; broadcasting the places would end at some.
    cut = whole.join(gone.hint("merge"), F.col("_row") == F.col("_gone"), "left")
    cut = cut.withColumn(text_col, F.when(F.col("dropped").isNull(), F.col(text_col)).otherwise(left))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
