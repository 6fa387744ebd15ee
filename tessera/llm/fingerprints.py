"""Document fingerprints: a digest of the quartiles of counts of hashed byte triplets.

Windows of five bytes give triplets of their first byte and two others; those are hashed into buckets and counted. The
digest keeps the text's length on a logarithmic scale, how the quartiles of the counts stand to each other, and for each bucket
the quartile that its count lies in. So it changes little when a part of the text does, and two digests are compared
by a bounded score of differences, without the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Buckets of triplets, and the bytes of the digest: length, ratios, two bits for each bucket.
BUCKETS = 256
_BYTES = 2 + BUCKETS // 4
#: Differences from this score on count as none in common; texts of one language that have nothing in common lie about there.
BOUND = 384
#: What a difference of one step costs: of a bucket's quartile by steps, of the length and of a ratio.
_STEPS = np.array([0, 1, 2, 6])
_LENGTH_STEP, _RATIO_STEP = 2, 4
#: Bytes counted at a time.
_PIECE = 1 << 20
#: Places of a window that a triplet is made of.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_U = np.uint32


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of data each bucket has."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), _PIECE):
        x = np.frombuffer(data[start : start + _PIECE + 4], np.uint8).astype(_U)
        for kind, (a, b, c) in enumerate(_TRIPLETS):
            n = min(_PIECE, len(x) - c)  # those that begin in this piece
            if n > 0:
                h = x[a : a + n] << _U(16) | x[b : b + n] << _U(8) | x[c : c + n]
                h = (h + _U(kind << 24)) * _U(2654435761)
                h = (h ^ h >> _U(15)) * _U(2246822519)
                counts += np.bincount((h ^ h >> _U(13)) & _U(BUCKETS - 1), minlength=BUCKETS)
    return counts


def digest(text: str) -> bytes:
    """The fingerprint of a text; equal texts have equal ones."""
    data = text.encode()
    counts = bucket_counts(data)
    low, middle, high = (int(q) for q in np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    quartile = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    packed = quartile[0::4] << 6 | quartile[1::4] << 4 | quartile[2::4] << 2 | quartile[3::4]
    ratios = min(15, 16 * low // max(1, high)) << 4 | min(15, 16 * middle // max(1, high))
    return bytes([min(255, int(8 * np.log2(len(data) + 1))), ratios]) + packed.astype(np.uint8).tobytes()


def _unpacked(digests: np.ndarray) -> np.ndarray:
    """Quartiles (rows, BUCKETS) of packed digests."""
    return (digests[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(len(digests), BUCKETS).astype(np.int8)


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 for equal digests, 0 for a score of BOUND and more, pair by pair."""
    x, y = (np.frombuffer(b"".join(side), np.uint8).reshape(-1, _BYTES) for side in (a, b))
    score = _STEPS[np.abs(_unpacked(x) - _unpacked(y))].sum(1)
    score += _LENGTH_STEP * np.abs(x[:, 0].astype(int) - y[:, 0])
    for shift in (4, 0):
        score += _RATIO_STEP * np.abs((x[:, 1] >> shift & 15).astype(int) - (y[:, 1] >> shift & 15))
    return 1.0 - np.minimum(score, BOUND) / BOUND


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """likeness() of two columns of fingerprints in hex; null if one is null."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        have = (a.notna() & b.notna()).to_numpy()
        out = pd.Series([None] * len(a), dtype=object)
        out[have] = likeness(*([bytes.fromhex(x) for x in side[have]] for side in (a, b)))
        return out.astype(float)

    return F.when(a.isNotNull() & b.isNotNull(), compared(a, b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, fingerprint): code points of each whole text, and its digest in lowercase hex.

    A null text is empty; an empty one has a digest of zeros. Null and repeated ids and repeated rows are kept, other
    columns ignored. Long texts are counted in pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([digest(t).hex() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_chars", "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def followed(docs: DataFrame, order_col: str, columns: list[str]) -> DataFrame:
    """The columns of docs and _part, _follows, by partitions in which each row stands before its next in descending order.

    order_col is unique and whole. Rows are dealt in ranges; the first row of a range is also there as a last one, with _follows = 1, of the range
    before, and the first of all after the last of all. Bounds of ranges are values of order_col, so each is the first row of
    its range: one pass over that column finds all that the driver has to know.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx(order_col, shares, 20 * parts).alias("q"), F.max(order_col).alias("last")).first()
    bounds = np.unique(np.array([*(found["q"] or []), *([found["last"]] if found["last"] is not None else [])], np.int64))

    @F.pandas_udf("array<int>")
    def dealt(number: pd.Series) -> pd.Series:
        """The row's range, and that which it follows if it begins one; ranges are counted down."""
        place = np.searchsorted(bounds, number.to_numpy())
        first = bounds[place] == number.to_numpy()
        own = len(bounds) - 1 - place
        return pd.Series([[o, (o - 1) % len(bounds)] if f else [o] for o, f in zip(own, first)])

    placed = docs.select(*columns, F.col(order_col).alias("_number"), dealt(order_col).alias("_parts"))
    each = placed.select(*columns, "_number", F.posexplode("_parts").alias("_follows", "_part"))
    return each.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_follows", F.desc("_number")).drop("_number")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has floor(n_chars / 3) code points of its end replaced by the first as many, or all, of the next document's, in
    descending order of id; the first follows the last. near_edited and near_next are the likeness of the fingerprint to those of
    the edited text and the next document.

    A null text is empty. Rows with null or repeated ids are kept: ids that are not unique and whole are ordered with null
    first of all, those of one id by a hash of the row. A single document is its own next one. Other columns are
    ignored. An empty table gives no rows. A task holds two texts and a batch.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = followed(scratch.ordered(plain, "id", "_order"), "_order", ["id", "text"])
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, id, text, digest
        for batch in batches:
            ids, sizes, hashes, own, other, after = [], [], [], [], [], []
            for i, text, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                text = text or ""
                here = digest(text)
                if before is not None and before[0] == part:
                    size = len(before[2])
                    edited = before[2][: size - size // 3] + text[: size // 3]
                    ids.append(before[1])
                    sizes.append(size)
                    hashes.append(hashlib.sha256(edited.encode()).hexdigest())
                    own.append(before[3])
                    other.append(digest(edited))
                    after.append(here)
                before = part, i.as_py(), text, here
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, batch.schema.field(0).type),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.string()),
                    pa.array([d.hex() for d in own], pa.string()),
                    pa.array([d.hex() for d in other], pa.string()),
                    pa.array(likeness(own, other), pa.float64()),
                    pa.array(likeness(own, after), pa.float64()),
                ],
                names=names,
            )

    kinds = [kind, "long", "string", "string", "string", "double", "double"]
    return rows.select("id", "text", "_follows", "_part").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
