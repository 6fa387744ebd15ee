"""SentencePiece encoding that keeps each piece's place in the original text, and decoding.

The text is normalized by the longest prefixes in the model's compiled character map, and for every character of the
result the byte it came from is kept; so each piece is projected to a span of the original bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.piece_model import PieceModel

#: Rows of one output batch of encode(), which holds whole lists of ids and spans.
_ROWS = 256

_SPANS = "n_tokens long, ids array<int>, begins array<int>, ends array<int>, decoded string"
_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in column)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_tokens, ids, begins, ends (bytes of the text's UTF-8), decoded.

    Ids include the begin and end ids. A null text is read as empty: two ids. Null or repeated id_col values are kept.
    Other columns are ignored. The model file is read by the driver and sent to the executors with a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                found = [model.encode(t) for t in _texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(i) for i, _, _ in found], pa.int64()),
                        *(pa.array([f[k].astype("int32") for f in found], ints) for k in range(3)),
                        pa.array([model.decode(i) for i, _, _ in found], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids", "begins", "ends", "decoded"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {_SPANS}")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_tokens, ids_sha256, decoded_sha256, span_bytes: what encode() gives, as digests.

    ids_sha256 is over little-endian unsigned 32-bit ids; span_bytes counts the bytes of the text that lie in the span
    of some piece, which are all. Nulls and repeated rows: as encode().
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(model: PieceModel, text: str) -> tuple[int, str, str, int]:
        ids, begins, ends = model.encode(text)
        decoded = model.decode(ids)
        # Spans follow one another; the bytes of one character share one.
        fresh = ends[1:] > ends[:-1]
        covered = int((ends[1:] - begins[1:])[fresh].sum())
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            rows = [digest(model, t) for t in _texts(batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {_DIGEST}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
