"""Arrays from .npy and .npz files: coordinates and vector spaces."""

from __future__ import annotations

import ast
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import norm, unit

#: Bytes of one array, at most.
MOST_BYTES = 1 << 30

# Fixed values of the file format: its first bytes, and the layout of the header's length by major version.
MAGIC = b"\x93NUMPY"
LENGTHS = {1: "<H", 2: "<I", 3: "<I"}
_KINDS = "fiub"  # floats, whole numbers and booleans


def npy_array(data: bytes) -> np.ndarray:
    """The numbers of a .npy file of one or two dimensions; ValueError for anything that is not whole and right."""
    if not data.startswith(MAGIC) or len(data) < 10 or data[6] not in LENGTHS:
        raise ValueError("no .npy file")
    layout = LENGTHS[data[6]]
    begin = 8 + struct.calcsize(layout)
    if len(data) < begin:
        raise ValueError("the header is cut")
    end = begin + struct.unpack(layout, data[8:begin])[0]
    if end > len(data):
        raise ValueError("the header is cut")
    try:
        header = ast.literal_eval(data[begin:end].decode("utf-8" if data[6] == 3 else "latin-1").strip())
        kind, shape, columns_first = np.dtype(header["descr"]), header["shape"], header["fortran_order"]
    except (ValueError, SyntaxError, KeyError, TypeError, MemoryError, RecursionError) as error:
        raise ValueError(f"a damaged header: {error}") from None
    if kind.kind not in _KINDS or not isinstance(columns_first, bool):
        raise ValueError(f"values of type {kind} are not read")
    if not isinstance(shape, tuple) or len(shape) not in (1, 2) or any(type(n) is not int or n < 0 for n in shape):
        raise ValueError(f"an array of shape {shape} is no vector and no list of vectors")
    size = kind.itemsize
    for n in shape:
        size *= n
    if size > MOST_BYTES:
        raise ValueError(f"an array of more than {MOST_BYTES} bytes")
    if size != len(data) - end:
        raise ValueError(f"{len(data) - end} bytes for an array of {size}")
    return np.frombuffer(data, kind, offset=end).reshape(shape, order="F" if columns_first else "C")


def npz_arrays(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Names and arrays of a .npz file, in its order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for member in archive.infolist():
                if not member.filename.endswith(".npy"):
                    raise ValueError(f"{member.filename} is no array")
                with archive.open(member) as file:
                    whole = file.read(MOST_BYTES + 4096)  # whatever size its entry states
                if len(whole) >= MOST_BYTES + 4096:
                    raise ValueError(f"an array of more than {MOST_BYTES} bytes")
                yield member.filename.removesuffix(".npy"), npy_array(whole)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, struct.error) as error:
        raise ValueError(f"a damaged archive: {error}") from None


def arrays(files: DataFrame) -> DataFrame:
    """(path, name, row, rank, values) of files (path, content): a row for each vector of each array.

    content is a .npy or .npz file, told by its first bytes. name is that of an array in an archive, empty for a single one. A single vector has
    row 0 and rank 1. A damaged file is an error that names its path.
    """

    def read(path: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
        try:
            if content.startswith(MAGIC):
                yield "", npy_array(content)
            else:
                yield from npz_arrays(content)
        except ValueError as error:
            raise ValueError(f"{path}: {error}") from None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for name, array in read(path.as_py(), content.as_py()):
                    rows = np.atleast_2d(array).astype(np.float64)
                    for start in range(0, len(rows), 256):
                        part = np.ascontiguousarray(rows[start : start + 256])
                        n, width = part.shape
                        offsets = pa.array(np.arange(n + 1) * width, pa.int32())
                        columns = [pa.array([path.as_py()] * n), pa.array([name] * n), pa.array(range(start, start + n), pa.int32()), pa.array([array.ndim] * n, pa.int32())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["path", "name", "row", "rank", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, row int, rank int, values array<double>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """arrays() of a file or a folder of files."""
    return arrays(spark.read.format("binaryFile").load(path))


def npy_bytes(values: Column) -> Column:
    """The .npy file of a vector of doubles."""
    length = F.size(values).cast("string")
    header = F.concat(F.lit("{'descr': '<f8', 'fortran_order': False, 'shape': ("), length, F.lit(",), }"))
    # The header ends with a new line, and the numbers begin at a multiple of 64 bytes.
    padded = F.concat(F.rpad(header, 117, " "), F.lit("\n"))
    start = F.concat(F.unhex(F.lit("934E554D5059" + "0100" + "7600")), padded.cast("binary"))

    @F.pandas_udf("binary")
    def packed(vectors):
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f8").tobytes())

    return F.concat(start, packed(values))


def coordinates(vectors: DataFrame, name: str | None = None, layer: int | None = None) -> DataFrame:
    """(coordinate, layer, vector, raw_vector, norm) of arrays() rows: a list of vectors has one for each layer.

    `layer` picks a row of a list, and is the layer of a single vector, else 0. The coordinate's name is, if none is given, that of the file without its
    ending. vector has length 1. A layer that a list lacks gives no rows.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    single = F.col("rank") == 1
    rows = vectors.withColumn("layer", F.when(single, F.lit(0 if layer is None else layer)).otherwise(F.col("row")).cast("int"))
    rows = rows if layer is None else rows.where(F.col("layer") == layer)
    return rows.select((F.lit(name) if name else stem).alias("coordinate"), "layer", unit(F.col("values")).alias("vector"), F.col("values").alias("raw_vector"), norm(F.col("values")).alias("norm"))


def vector_space(vectors: DataFrame, layer: int | None = None) -> DataFrame:
    """(layer, concept, vector) of arrays() rows of an archive: arrays named layer_12__happy, or, with a given layer, by the concept alone.

    A name without a layer, where none is given, and an array that is no single vector are errors.
    """
    named = F.regexp_extract("name", r"^layer_(\d+)__(.+)$", 1)
    has = named != ""
    fits = (F.col("rank") == 1) & (has | F.lit(layer is not None))
    problem = F.raise_error(F.concat("path", F.lit(": "), "name", F.lit(" is no vector with a layer in its name")))
    at = F.when(~fits, problem.cast("int")).when(has, named.cast("int")).otherwise(F.lit(layer).cast("int"))
    concept = F.when(has, F.regexp_extract("name", r"^layer_(\d+)__(.+)$", 2)).otherwise(F.col("name"))
    found = vectors.select(at.alias("layer"), concept.alias("concept"), F.col("values").alias("vector"))
    return found if layer is None else found.where(F.col("layer") == layer)
