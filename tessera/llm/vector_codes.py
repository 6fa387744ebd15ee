"""Compression of vectors to codes of product quantization, by Lloyd's rounds with adaptive distance bounds.

Each part of a vector keeps its b closest codebook entries, in order, with a lower bound of its distance to each, and one
outer bound for all the others (Drake and Hamerly). When the entries move, bounds give way by how far they moved; only
entries whose bound is not above the distance to the present one are looked at again, and if that holds for the outer
bound too, all are. Distances are compared as exact integers, so equal ones are settled by index. b follows what
the last round needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Entries with bounds at first; beyond GROW of the parts without a bound that holds, twice as many; else as many as ENOUGH of the parts need.
CLOSEST, GROW, ENOUGH = 16, 0.1, 0.98
#: Parts of the rows of a label, when its sum is joined to them.
_SALTS = 32
#: Distances are worked out for so many parts at a time.
_CHUNK = 4096
#: Bounds are made smaller, and distances larger, by so much that rounding can't make them wrong.
_LESS, _MORE = 1 - 1e-12, 1 + 1e-12

_STATE = "vec_id {id}, label {label}, vec binary, near binary, bounds binary, needed binary, error long"


class Codebooks:
    """Integer entries of each part: an array (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.size, self.width = entries.shape
        self.code = np.uint8 if self.size <= 256 else np.uint16 if self.size <= 65536 else np.uint32
        #: Components that are not below it would overflow a long when distances are summed over parts.
        self.limit = int((2**61 / max(1, self.width * self.parts)) ** 0.5)

    def check(self, values: np.ndarray) -> None:
        if values.size and int(np.abs(values).max()) >= self.limit:
            raise ValueError(f"components of {self.limit} and more, after scaling, overflow the sum of squares")

    def distances(self, part: int, values: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows, entries)."""
        entries = self.entries[part]
        largest = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if 4 * self.width * largest**2 < 2**53:  # all sums are whole numbers that a double holds
            x, c = values.astype(np.float64), entries.astype(np.float64)
            return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
        out = np.zeros((len(values), self.size), np.int64)
        for i in range(self.width):
            out += (values[:, i : i + 1] - entries[None, :, i]) ** 2
        return out

    def closest(self, part: int, values: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the b closest entries in order, their exact distances, and a bound for the others."""
        near, exact, outer = [], [], []
        for start in range(0, len(values), _CHUNK):
            found = self.distances(part, values[start : start + _CHUNK])
            order = np.argsort(found, axis=1, kind="stable")  # equal distances stay in the order of the index
            near.append(order[:, :b])
            exact.append(np.take_along_axis(found, near[-1], 1))
            rest = np.take_along_axis(found, order[:, b : b + 1], 1)
            outer.append(np.sqrt(rest[:, 0].astype(np.float64)) * _LESS if self.size > b else np.full(len(found), np.inf))
        if not near:
            return np.zeros((0, b), np.int64), np.zeros((0, b), np.int64), np.zeros(0)
        return np.concatenate(near), np.concatenate(exact), np.concatenate(outer)


def _first(books: Codebooks, part: int, values: np.ndarray, b: int):
    """near, bounds (with the outer one last), how many entries were looked at, and the squared distance to the closest."""
    near, exact, outer = books.closest(part, values, b)
    bounds = np.concatenate([np.sqrt(exact.astype(np.float64)) * _LESS, outer[:, None]], 1)
    return near, bounds, np.full(len(values), b + 1), exact[:, 0]


def _again(old: Codebooks, new: Codebooks, part: int, values: np.ndarray, near: np.ndarray, bounds: np.ndarray):
    """_first() of the new entries, from what was known of the old ones."""
    b = near.shape[1]
    moved = (new.entries[part] - old.entries[part]).astype(np.float64)
    moved = np.sqrt((moved * moved).sum(1)) * _MORE
    bounds = np.concatenate([bounds[:, :b] - moved[near], bounds[:, b:] - moved.max(initial=0)], 1)
    here = ((values - new.entries[part][near[:, 0]]) ** 2).sum(1)
    bounds[:, 0] = np.sqrt(here.astype(np.float64)) * _LESS
    reach = np.sqrt(here.astype(np.float64)) * _MORE
    least = np.minimum.accumulate(bounds[:, :0:-1], axis=1)[:, ::-1]  # of the places 1 to b and all after each
    needed = 1 + (reach[:, None] >= least).sum(1)
    for m in np.unique(needed):
        rows = np.flatnonzero(needed == m)
        if m == b + 1:
            found, exact, outer = new.closest(part, values[rows], b)
            near[rows], bounds[rows, :b], bounds[rows, b] = found, np.sqrt(exact.astype(np.float64)) * _LESS, outer
            here[rows] = exact[:, 0]
        elif m > 1:
            some = near[rows, :m]
            exact = ((values[rows][:, None, :] - new.entries[part][some]) ** 2).sum(2)
            order = np.lexsort((some, exact), axis=1)
            exact = np.take_along_axis(exact, order, 1)
            near[rows, :m] = np.take_along_axis(some, order, 1)
            bounds[rows, :m] = np.sqrt(exact.astype(np.float64)) * _LESS
            here[rows] = exact[:, 0]
    return near, bounds, needed, here


def _narrowed(near: np.ndarray, bounds: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The first b entries; the bounds of the others join the outer one."""
    return near[:, :b], np.concatenate([bounds[:, :b], bounds[:, b:].min(1, keepdims=True)], 1)


def _down(bounds: np.ndarray) -> np.ndarray:
    """Bounds as single floats that are no greater."""
    single = bounds.astype(np.float32)
    return np.where(single > bounds, np.nextafter(single, np.float32(-np.inf)), single)


def _whole(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of list values of one width, as an array (rows, width)."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"all vectors must have {width} components")
    floats = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(column), width)
    if floats.size and np.abs(floats).max() >= 2**62:
        raise ValueError("components are too large")
    return floats.astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _array(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _state(batch: pa.RecordBatch, vec: np.ndarray, books: Codebooks, b: int, old: Codebooks | None, old_b: int) -> pa.RecordBatch:
    """The rows of the next state: parts that have no bounds yet, or are to have more, are looked at anew."""
    n, near, bounds = len(vec), np.zeros((len(vec), books.parts, b), books.code), np.zeros((len(vec), books.parts, b + 1), np.float32)
    needed, error = np.zeros((n, books.parts), np.uint16), np.zeros(n, np.int64)
    cut = vec.reshape(n, books.parts, books.width)
    if old is not None and b <= old_b:
        before = _array(batch.column(3), books.code, books.parts, old_b), _array(batch.column(4), np.float32, books.parts, old_b + 1)
    for part in range(books.parts):
        if old is None or b > old_b:
            found = _first(books, part, cut[:, part], b)
        else:
            found = _again(old, books, part, cut[:, part], before[0][:, part].astype(np.int64), before[1][:, part].astype(np.float64))
        kept, low = _narrowed(*found[:2], b)
        near[:, part], bounds[:, part], needed[:, part] = kept, _down(low), found[2]
        error += found[3]
    small = vec.astype(np.int16 if np.abs(vec).max(initial=0) < 2**15 else np.int64)
    columns = [batch.column(0), batch.column(1), _binary(small), _binary(near), _binary(bounds), _binary(needed), pa.array(error)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vec", "near", "bounds", "needed", "error"])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a state, which are kept in two or eight bytes a component."""
    rows = column.to_pylist()
    if all(len(r) == 2 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), width).astype(np.int64)
    return np.array([np.frombuffer(r, np.int16 if len(r) == 2 * width else np.int64) for r in rows], np.int64).reshape(len(rows), width)


def _sums(state: DataFrame, books: Codebooks, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Componentwise sums and counts of the parts of each entry, and how many parts needed so many entries.

    A task gives one row for each entry, and those are summed: parts * entries of them reach the driver.
    """
    parts, size, width, code = books.parts, books.size, books.width, books.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, used = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            vec = _vectors(batch.column(0), parts * width).reshape(batch.num_rows, parts, width)
            near = _array(batch.column(1), code, parts, b)[:, :, 0].astype(np.int64)
            used += np.bincount(_array(batch.column(2), np.uint16, parts).ravel(), minlength=len(used))
            for part in range(parts if len(vec) else 0):
                order = np.argsort(near[:, part], kind="stable")
                entries, starts = np.unique(near[order, part], return_index=True)
                sums[part, entries] += np.add.reduceat(vec[order, part], starts, axis=0)
                counts[part] += np.bincount(near[:, part], minlength=size)
        at = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at[:, 0], np.full(np.count_nonzero(used), -1)), pa.int32()),
                pa.array(np.append(at[:, 1], np.flatnonzero(used)), pa.int32()),
                pa.array(np.append(counts[counts > 0], used[used > 0]), pa.int64()),
                pa.array([*sums[counts > 0].tolist(), *[[0] * width] * np.count_nonzero(used)], pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = state.select("vec", "near", "needed").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    summed = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    sums, counts, used = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64), np.zeros(1 << 16, np.int64)
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *summed).collect():
        if row[0] < 0:
            used[row[1]] = row[2]
        else:
            counts[row[0], row[1]], sums[row[0], row[1]] = row[2], row[3:]
    return sums, counts, used


def _adapted(used: np.ndarray, b: int, size: int) -> int:
    """Entries with bounds in the next round."""
    total = max(1, used.sum())
    if used[b + 1 :].sum() > GROW * total:
        return min(2 * b, size)
    return min(b, max(2, int(np.searchsorted(np.cumsum(used), ENOUGH * total))), size)


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors (id_col, label, codes array<int>, error), and the codebooks.

    Components become floor(scale * x); a vector is cut into equal consecutive parts. The codebooks begin as the parts of the
    vectors with the least ids, null last, equal ids in the order of their components; there are fewer entries if there
    are fewer vectors. A round gives each part to the nearest entry, the lower index of equally near ones, and replaces an
    entry by the floor of its parts' mean; an entry without parts stays.

    Vectors that are null or have a component that is null, NaN or infinite are left out. Null labels, null and repeated
    ids and repeated rows are kept; other columns are ignored. Vectors of different lengths, lengths that parts do not
    divide, and components so large that squares overflow a long raise ValueError. Empty vectors have codes of zeros. An
    empty table gives no rows and no entries. The state of a round is a written table, of which two are there at a time;
    the driver holds the codebooks only.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", bad))
    begun = [r["vec"] for r in rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()]
    width = len(begun[0]) if begun else 0
    if width % parts or any(len(v) != width for v in begun):
        raise ValueError(f"vectors must have one length that {parts} divides")
    start = _whole(pa.array(begun, pa.list_(pa.float64())), scale, width) if begun else np.zeros((0, 0), np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(begun), parts, width // parts).transpose(1, 0, 2)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    if not begun:
        none = spark.createDataFrame([], f"`{id_col}` {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
        return none, books

    b, state, old, old_b = min(CLOSEST, books.size), None, None, 0
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, b, old, old_b))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books, b, old, old_b = shared.value
            for batch in batches:
                if old is None:
                    vec = _whole(batch.column(2), scale, books.parts * books.width)
                    books.check(vec)
                else:
                    vec = _vectors(batch.column(2), books.parts * books.width)
                yield _state(batch, vec, books, b, old, old_b)

        state = scratch.last((rows if state is None else state).mapInArrow(run, schema), f"state-{turn}")
        if turn == rounds:
            break
        sums, counts, used = _sums(state, books, b)
        means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
        entries_now = np.where(counts[:, :, None] > 0, means, books.entries)
        old, old_b, books = books, b, Codebooks(entries_now)
        if turn:  # the first round looks at all entries, whatever is needed
            b = _adapted(used, b, books.size)

    code, last = books.code, b

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _array(batch.column(2), code, parts, last)[:, :, 0].astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, parts), pa.int32()), pa.array(found.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed, batch.column(3)], names=[id_col, "label", "codes", "error"])

    out = state.select("vec_id", "label", "near", "error").mapInArrow(codes, f"`{id_col}` {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")
    return out, books


def decoded(codes: DataFrame, books: Codebooks, id_col: str = "vec_id") -> DataFrame:
    """(id_col, vec array<long>): the vectors that codes stand for."""
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]).cast("array<bigint>") for e in part]) for part in books.entries]
    return codes.select(id_col, F.concat(*[F.get(t, F.get("codes", F.lit(i))) for i, t in enumerate(tables)]).alias("vec"))


def code_digests(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of vector_codes(): codes in hex, and errors summed by label.

    A label's sum is joined to its rows in parts, so that one label may have most of them.
    """
    codes, books = vector_codes(vectors, id_col=id_col, **options)
    digits = 2 * np.dtype(books.code).itemsize
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), digits, "0"))), "")
    rows = codes.select(id_col, "label", code.alias("code"), "error", F.pmod(F.xxhash64(id_col), F.lit(_SALTS)).alias("_salt"))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    sums = sums.withColumnRenamed("label", "_label")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of")))
    return joined.select(id_col, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return code_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds, one after the other, over one row for each component."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
distance{i} AS (
  SELECT x.row, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d
  FROM component x JOIN book{i} c ON c.part = x.part AND c.place = x.place GROUP BY ALL
),
chosen{i} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM distance{i} GROUP BY row, part)""")
        if i < rounds:
            steps.append(f"""
sum{i} AS (SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM chosen{i} JOIN component USING (row, part) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM book{i} LEFT JOIN sum{i} USING (part, entry, place)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
numbered AS (SELECT row, len(embedding) // {parts} AS width, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM kept),
component AS MATERIALIZED (SELECT row, i // width AS part, i % width AS place, floor(1024 * x)::BIGINT AS v FROM numbered),
book0 AS (SELECT part, row - 1 AS entry, place, v FROM component WHERE row <= {entries}),
{",".join(steps)},
coded AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM chosen{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), books
"""


SQL = _sql()
