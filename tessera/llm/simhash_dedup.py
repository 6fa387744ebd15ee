"""Near duplicates by SimHash, compared exactly in tiles.

A fingerprint's lanes have population counts, its signature. Two fingerprints that differ in at most `radius` bits have
signatures whose differences sum to at most `radius`, so tiles (fingerprints of one signature) are compared only with
tiles of such signatures. Within a pair of tiles all pairs are compared by exclusive-or and bit counts in numpy. Each
pair of tiles yields a spanning forest of its links, of the nearest ones, never all pairs, and connected components of
these give the groups.

For a small radius a signature has four lanes, which skips nearly all pairs of tiles; for a large one, which few pairs
of lanes would rule out, one lane and larger tiles. Either way the pairs of tiles grow with the square of the
fingerprints: that is the method's.

simhash_dedup, whose links must pass an exact check, compares fewer: fingerprints are dealt by the least hashes of their
texts' shingles, so many of each that two texts of the similarity have one in common whatever else differs. No pair that
would pass the check is left out, and texts without a common shingle there are never compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.scratch import Scratch
from tessera.llm.words import BASE, hashed_texts, mix, word_blocks

#: Lanes and fingerprints of a tile up to a radius; a pair of tiles is a row of about 8 KB, or 32 KB.
_NEAR, _LANES, TILE = 3, 4, 512
_FAR_LANES, FAR_TILE = 1, 2048
#: Rows with one shingle: of up to _FEW all links are checked, of more a spanning forest first, made tile by tile; more than _RUN are dealt again.
_FEW, _RUN = 16, 1 << 14
#: A lane's count is at most 64; sums of signatures stay apart in this base.
_BASE = 256
#: Near duplicates of the pipeline: shingles of five words, a similarity of 0.8. Fingerprints of texts that similar
#: differ in 10 bits on average, and 97 of 100 such pairs in 15 or fewer.
SHINGLE_WORDS, SIMILARITY, RADIUS = 5, 0.8, 15
#: Bits that a fingerprint and a second one, from other hashes of the same shingles, differ in together: 19 on average. Unrelated texts that
#: are within the radius by chance are told by it, so that hardly any of their links stand between those of similar texts.
BOTH = 28

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _ones(hashes: list[int]) -> np.ndarray:
    """For each of the 64 bits, the hashes that have it."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[start : start + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def simhash(text: str | None, shingle_words: int = 3) -> int:
    """Bit i is 1 if it is 1 in over half of the hashes of the text's shingles; 0 where there are no words."""
    return _prints(text, shingle_words, False)[0]


def _prints(text: str | None, shingle_words: int, second: bool, seen: list[np.ndarray] | None = None) -> tuple[int, int]:
    """The fingerprint of a text, and one of other hashes of its shingles (or 0). The hashes are added to seen."""
    total, other, count, tail = np.zeros(64, np.int64), np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):  # bytes.lower() maps A-Z only
        words = tail + words
        hashes = list(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))))
        total += _ones(hashes)
        if second:
            other += _ones(_rehashed(hashes))
        if seen is not None:
            seen.append(np.unique(np.array(hashes, np.uint64)))
        count += len(hashes)
        tail = words[max(0, len(words) - shingle_words + 1) :]
    if not count:
        one = _hash(b" ".join(tail)) if tail else 0
        if seen is not None:
            seen.append(np.array([one], np.uint64))
        return one, int(_rehashed([one])[0]) if tail and second else 0
    return tuple(int.from_bytes(np.packbits(2 * t > count, bitorder="little").tobytes(), "little") for t in (total, other))


def _rehashed(hashes: list[int]) -> np.ndarray:
    return mix(np.array(hashes, np.uint64) ^ np.uint64(BASE))


def _least(seen: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least of the distinct hashes, one more than a text of that similarity can lack: two such texts have one of these in common."""
    found = np.unique(np.concatenate(seen))
    return found[: len(found) - math.ceil(similarity * len(found) * (1 - 1e-12)) + 1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, similarity: float | None = None) -> DataFrame:
    """(id_col, fp long) for each row; fp holds the 64 bits. A null text has no words.

    With `similarity` also fp2, a second fingerprint, and keys, the hashes of which texts of that similarity have one in common.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["fp"] if similarity is None else ["fp", "fp2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part, keys, found = batch.slice(start, 1024), [], []
                for t in part.column(1):
                    seen = None if similarity is None else []
                    found.append(_prints(t.as_py(), shingle_words, similarity is not None, seen))
                    if seen is not None:
                        keys.append(_least(seen, similarity).view(np.int64))
                found = np.array(found, np.uint64).reshape(-1, 2)
                columns = [part.column(0), *(pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(len(names)))]
                if similarity is not None:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names, "keys"][: len(columns)])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ("" if similarity is None else ", keys array<long>")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _signature(fp: Column, lanes: int) -> Column:
    bits = 64 // lanes
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    lanes = [F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(mask)) for i in range(lanes)]
    return sum(lane.cast("long") * _BASE**i for i, lane in enumerate(lanes))


def _offsets(radius: int, lanes: int) -> list[int]:
    """Differences of the signatures of two fingerprints within the radius, each pair of signatures once."""
    steps = itertools.product(range(-radius, radius + 1), repeat=lanes)
    sums = (sum(d * _BASE**i for i, d in enumerate(s)) for s in steps if sum(map(abs, s)) <= radius)
    return sorted(s for s in sums if s >= 0)


def _close(left: np.ndarray, right: np.ndarray, radius: int, same: bool, second: tuple[np.ndarray, np.ndarray] | None = None, both: int = 0) -> tuple[np.ndarray, ...]:
    """Places in left and in right, and the bits that differ, of each link of a pair of tiles.

    With second fingerprints, links differ in at most `both` bits of the two together.
    """
    found = []
    for start in range(0, len(left), 256):
        bits = np.bitwise_count(left[start : start + 256, None] ^ right[None, :])
        one, two = np.nonzero(bits <= radius)
        one, two, bits = (one + start).astype(np.int32), two.astype(np.int32), bits[one, two]
        if second:
            bits = bits + np.bitwise_count(second[0][one] ^ second[1][two])
        once = (one < two if same else np.ones(len(one), bool)) & ((bits <= both) if second else True)
        found.append((one[once], two[once], bits[once]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _forest(one: np.ndarray, two: np.ndarray, bits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that connect what all links between `count` nodes connect: a spanning forest of the nearest ones."""
    order = np.argsort(bits, kind="stable")  # of equally near links the first
    one, two, bits = one[order], two[order], bits[order]
    label, at, taken = np.arange(count), np.arange(len(one)), []
    while True:
        at = at[label[one[at]] != label[two[at]]]
        if not len(at):
            taken.sort()
            return one[taken], two[taken], bits[taken]
        # The nearest link of each part that is connected so far: of values set at one place the last stays.
        nearest = np.full(count, len(one))
        for end in (one, two):
            first = np.full(count, len(one))
            first[label[end[at[::-1]]]] = at[::-1]
            nearest = np.minimum(nearest, first)
        ends = np.flatnonzero(nearest < len(one))
        parent = dict(zip(ends.tolist(), ends.tolist()))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in np.unique(nearest[ends]).tolist():
            a, b = root(int(label[one[k]])), root(int(label[two[k]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                taken.append(k)
        to = np.arange(count)
        to[ends] = [root(x) for x in ends.tolist()]
        label = to[label]


def near_links(distinct: DataFrame, radius: int, scratch: Scratch, tile: int | None = None) -> DataFrame:
    """(src, dst): links of the distinct fingerprints (column fp) that connect all which differ in radius bits or less."""
    lanes, tile = (_LANES, tile or TILE) if radius <= _NEAR else (_FAR_LANES, tile or FAR_TILE)
    signed = distinct.select("fp", _signature(F.col("fp"), lanes).alias("sig"))
    # At most 17 ** 4 signatures, whatever the input: a table of at most 83,521 small rows.
    parts = signed.groupBy("sig").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = signed.join(F.broadcast(parts), "sig").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    tiles = scratch.write(dealt.groupBy("sig", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    left = tiles.select(
        F.col("sig").alias("sig_a"), F.col("part").alias("part_a"), F.col("fps").alias("a"), F.explode(F.array(*map(F.lit, _offsets(radius, lanes)))).alias("step")
    ).withColumn("sig", F.col("sig_a") + F.col("step"))
    pairs = left.join(tiles.withColumnRenamed("fps", "b"), "sig").where("step > 0 or part_a <= part")
    pairs = pairs.select("a", "b", F.expr("step = 0 and part_a = part").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(*(batch.column(i) for i in range(3))):
                one, two = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
                src, dst, bits = _close(one, two, radius, same.as_py())
                if len(src):
                    nodes = one if same.as_py() else np.concatenate([one, two])
                    src, dst, _ = _forest(src, dst + len(nodes) - len(two), bits, len(nodes))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[c].view(np.int64)) for c in (src, dst)], names=["src", "dst"])

    return scratch.write(pairs.mapInArrow(run, "src long, dst long").distinct(), "links")


def _few_links(key: np.ndarray, row: np.ndarray, fp: np.ndarray, fp2: np.ndarray, radius: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """All links between rows of equal keys, which lie side by side; each is compared with the next, the one after..."""
    src, dst, at, step = [], [], np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (src, dst))
        bits = np.bitwise_count(fp[at] ^ fp[at + step])
        near = at[(bits <= radius) & (bits + np.bitwise_count(fp2[at] ^ fp2[at + step]) <= both)]
        src.append(row[near])
        dst.append(row[near + step])
        step += 1


def _many_links(row: np.ndarray, fp: np.ndarray, fp2: np.ndarray, label: np.ndarray | None, radius: int, both: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the nearest links between rows of one key, from those of its pairs of tiles; with labels, all links between different ones."""
    order = np.argsort(row)  # of equally near links the same ones are taken for every key
    row, fp, fp2 = row[order], fp[order], fp2[order]
    if label is not None:
        label = label[order]
        if (label == label[0]).all():
            return
    links = []
    for a in range(0, len(row), FAR_TILE):
        for b in range(a, len(row), FAR_TILE):
            one, two = slice(a, a + FAR_TILE), slice(b, b + FAR_TILE)
            src, dst, bits = _close(fp[one], fp[two], radius, a == b, (fp2[one], fp2[two]), both)
            src, dst = src + a, dst + b
            if label is None:
                links.append(_forest(src, dst, bits, len(row)))
            else:
                apart = label[src] != label[dst]
                yield row[src[apart]], row[dst[apart]]
    if links:
        src, dst, bits = (np.concatenate(c) for c in zip(*links))
        order = np.lexsort((dst, src))
        src, dst, _ = _forest(src[order], dst[order], bits[order], len(row))
        yield row[src], row[dst]


_DEALT = ["key", "row", "fp", "fp2"]


def _by_key(dealt: DataFrame, schema: str, linked: Callable, most: int | None) -> DataFrame:
    """What `linked` makes of the columns of dealt, whole keys at a time; it is also told which rows are of keys with more than `most`, which come in parts."""
    columns = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.zeros(0, np.int64)] * len(columns), None  # the rows of the last key, which may go on, and the last large key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            sizes = np.diff(np.append(starts, len(rows[0])))
            big = np.repeat((sizes > most) | (rows[0][starts] == large) if most else np.zeros(len(starts), bool), sizes)
            ready = big | (np.arange(len(rows[0])) < starts[-1])
            large = rows[0][big][-1] if big.any() else large
            yield from linked([c[ready] for c in rows], big[ready])
            held = [c[~ready] for c in rows]
        yield from linked(held, np.zeros(len(held[0]), bool))

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _words(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.view(np.uint64) for c in columns]  # bitwise_count takes the absolute value of signed numbers


def _first_links(dealt: DataFrame, radius: int, both: int) -> DataFrame:
    """(src, dst, key, fp, fp2): all links between rows of dealt (key, row, fp, fp2) with a key that up to _FEW have. The rows of other keys are
    returned as they are, as src, without a dst; for links, key, fp and fp2 are null."""
    few = _FEW

    def linked(columns: list[np.ndarray], big: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = [c[~big] for c in columns]
        src, dst = _few_links(*left[:2], *_words(left[2:]), radius, both)
        none = pa.nulls(len(src), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst)), none, none, none], names=["src", "dst", *_DEALT[:1], *_DEALT[2:]])
        key, row, *prints = (pa.array(c[big]) for c in columns)
        yield pa.RecordBatch.from_arrays([row, pa.nulls(len(row), pa.int64()), key, *prints], names=["src", "dst", *_DEALT[:1], *_DEALT[2:]])

    return _by_key(dealt.select(*_DEALT), "src long, dst long, key long, fp long, fp2 long", linked, few)


def _further_links(many: DataFrame, radius: int, both: int, scratch: Scratch) -> DataFrame:
    """(src, dst): links that connect what all links between rows of many (key, row, fp, fp2) with one key connect; with a column label, all
    links between rows of different ones. Keys with more than _RUN rows are dealt by pairs of parts."""
    counts = many.groupBy("key").agg(F.ceil(2 * F.count("*") / _RUN).cast("int").alias("parts")).where("parts > 2")
    large = scratch.write(counts, "large")
    dealt = many
    if count := large.count():
        large = F.broadcast(large) if count <= _BROADCAST_ROWS else large
        tiled = many.join(large, "key").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiled = tiled.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).select(many.columns)
        dealt = many.join(large, "key", "left_anti").unionByName(tiled)

    def linked(columns: list[np.ndarray], big: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, row, *rest = columns
        if not len(key):
            return
        fp, fp2 = _words(rest[:2])
        starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist()
        for a, b in zip(starts, starts[1:]):
            for src, dst in _many_links(row[a:b], fp[a:b], fp2[a:b], rest[2][a:b] if len(rest) > 2 else None, radius, both):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return _by_key(dealt, "src long, dst long", linked, None).distinct()


def checked_links(found: DataFrame, radius: int, both: int, check: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(src, dst): links that connect all that is connected by links which `check` leaves: links of rows of found (row, fp, fp2, keys) that have a
    key in common and differ in at most radius bits of fp, and `both` of fp and fp2 together.

    Of a key with many rows a forest is checked first. Where that leaves its rows in different components, a link that is no part of it may stand
    the check, so all links between these are checked too.
    """
    dealt = found.select(F.explode("keys").alias("key"), "row", "fp", "fp2")
    links = scratch.write(_first_links(dealt, radius, both), "links")
    many, pairs = links.where("dst is null").select("key", F.col("src").alias("row"), "fp", "fp2"), links.where("dst is not null").select("src", "dst").distinct()
    some = many.limit(1).count()
    if some:
        pairs = pairs.unionByName(_further_links(many, radius, both, scratch)).distinct()
    pairs = scratch.write(pairs, "pairs")
    good = scratch.write(check(pairs), "checked")
    if not some or not pairs.join(good, ["src", "dst"], "left_anti").limit(1).count():
        return good
    roots = connected_components(good, scratch)
    many = many.join(roots, F.col("row") == F.col("node"), "left").select(*_DEALT, F.coalesce("root", "row").alias("label"))
    more = scratch.write(_further_links(many, radius, both, scratch).join(pairs, ["src", "dst"], "left_anti"), "more")
    return good.unionByName(check(more))


def link_fingerprints(distinct: DataFrame, radius: int, scratch: Scratch, tile: int | None = None) -> DataFrame:
    """(node, root) for the distinct fingerprints (column fp) that are linked to another, directly or by others."""
    return connected_components(near_links(distinct, radius, scratch, tile), scratch)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (the least id reachable).

    A null text has no words, and all texts without words have fingerprint 0, which links like any other. Null ids
    take part, but are no component_id unless a component has no other. Repeated rows are rows of one component.
    An empty table gives no rows. Columns other than the two named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.write(fingerprints(docs, id_col, text_col, shingle_words).withColumnRenamed(id_col, "id"), "fingerprints")
    first = scratch.write(found.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = link_fingerprints(first, radius, scratch)
    members = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    members = scratch.write(members, "members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = scratch.write(members.join(least, "root").select("fp", "component_id"), "components")
    scratch.only(found, ids)
    return found.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Up to this many dropped rows their numbers are broadcast; more are joined by a shuffle.
_BROADCAST_ROWS = 500_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words, A-Z in lower case; of all words if there are fewer."""
    words, _ = hashed_texts([text])
    count = max(1, len(words) - size + 1)
    found = np.zeros(count if len(words) else 0, np.uint64)
    for j in range(min(size, len(words))):
        found = mix(found + words[j : j + count])
    return np.unique(found)


def _similar(rows: DataFrame, pairs: DataFrame, shingle_words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (src, dst) of rows (row, text) whose shingles have at least this share in common."""
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("of")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = pa.array([shingles(t.as_py(), shingle_words).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["row", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, sides in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in sides)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = common >= similarity * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(2)], names=["src", "dst"])

    chosen = rows.join(wanted, F.col("row") == F.col("of"), "left_semi").select("row", "text").mapInArrow(hashed, "row long, shingles binary")
    chosen = scratch.write(chosen, "shingles")
    one, two = (chosen.select(F.col("row").alias(end), F.col("shingles").alias(f"{end}_shingles")) for end in ("src", "dst"))
    whole = pairs.join(one, "src").join(two, "dst").select("src", "dst", "src_shingles", "dst_shingles")
    return whole.mapInArrow(compared, "src long, dst long")


def simhash_dedup(
    docs: DataFrame, text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", both: int = BOTH
) -> DataFrame:
    """The rows of docs but those of whose group another stays; all columns, whatever their names.

    Links between texts whose fingerprints differ in at most radius bits, and in at most `both` with second fingerprints, are checked: the shingles that two texts have
    in common are at least `similarity` (more than 0) of those of either. What links connect is a group, and of each the row with the
    least id stays, of equal ids that with the least hash of the row; rows without an id come last. Texts without words, null
    ones too, are one group. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash-dedup")
    whole = scratch.ordered(docs, id_col, "_row")
    rows = whole.select(F.col("_row").alias("row"), F.col(text_col).alias("text"))
    digests = scratch.write(rows.select("row", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.write(digests.join(firsts, "digest").where("row != first").select("row"), "copies")
    found = scratch.write(fingerprints(rows, "row", "text", shingle_words, similarity), "fingerprints")
    # Of equal texts, told by their digests, only the first takes part.
    found = found.join(F.broadcast(copies) if copies.count() <= _BROADCAST_ROWS else copies, "row", "left_anti")
    links = checked_links(found, radius, both, lambda pairs: _similar(rows, pairs, shingle_words, similarity, scratch), scratch)
    roots = connected_components(links, scratch)
    gone = scratch.last(roots.where("node != root").select(F.col("node").alias("row")).unionByName(copies).distinct(), "gone").withColumnRenamed("row", "_gone")
    gone = F.broadcast(gone) if gone.count() <= _BROADCAST_ROWS else gone
    return whole.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
