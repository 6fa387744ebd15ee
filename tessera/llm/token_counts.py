"""Token counts of greedy word-piece segmentation by a linear longest-match automaton.

The vocabulary is a trie with two roots, for pieces that begin a word and pieces that continue one. A node's failure
link leads to where matching goes on once the longest pieces that lie before it are taken off, and its pop count says
how many pieces those are. So a word is counted in one pass over its bytes, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memo import Memo
from tessera.llm.words import word_blocks

_START, _GOES_ON, _NONE = 0, 1, -1
#: Counts kept by a Python worker, by word.
_MEMO = 300_000


class LongestMatch:
    """Counts the pieces of words for a vocabulary of byte strings."""

    def __init__(self, starting: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: dict[int, int] = {}
        pieces = [False, False]
        for root, vocabulary in ((_START, starting), (_GOES_ON, continuing)):
            for piece in vocabulary:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.next.get(key, _NONE)
                    if node == _NONE:
                        node = self.next[key] = len(pieces)
                        pieces.append(False)
                pieces[node] = bool(piece) or pieces[node]
        self._link(pieces)

    def _link(self, pieces: list[bool]) -> None:
        """Failure links and pop counts, in the order of depth."""
        self.fail, self.pops = [_NONE] * len(pieces), [0] * len(pieces)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.next.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        level = [_START, _GOES_ON]
        while level:
            deeper = []
            for parent in level:
                for byte, node in below.get(parent, ()):
                    deeper.append(node)
                    if pieces[node]:
                        self.fail[node], self.pops[node] = _GOES_ON, 1
                        continue
                    at, pops = self.fail[parent], self.pops[parent]
                    while at != _NONE and at << 8 | byte not in self.next:
                        pops += self.pops[at]
                        at = self.fail[at]
                    if at != _NONE:
                        self.fail[node], self.pops[node] = self.next[at << 8 | byte], pops
            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 (the unknown token) if longest matches don't cover it, 0 for an empty word."""
        follow, fail, pops = self.next, self.fail, self.pops
        node, total = _START, 0
        for byte in word:
            while (found := follow.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node == _NONE:
                    return 1
            node = found
        while node not in (_GOES_ON, _START):
            total += pops[node]
            node = fail[node]
            if node == _NONE:
                return 1
        return total


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a file of ranks: a base64 piece and its rank in each line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


def token_counts(
    docs: DataFrame, starting: Iterable[bytes], continuing: Iterable[bytes], id_col="doc_id", text_col="text", before: bytes = b" "
) -> DataFrame:
    """For each row: id_col, n_words, n_tokens.

    Words are runs of characters other than space and 0x09-0x0D, each matched with `before` put in front. A null or
    empty text has 0 words and tokens. Null and repeated ids are kept; other columns are ignored. The automaton is
    built once by the driver and broadcast: its size is bounded by the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(starting, continuing))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value.count
        memo = Memo(lambda word: count(before + word), _MEMO)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                lists = [(len(w), sum(memo.of(w))) for w in word_blocks((text.as_py() or "").encode())]
                words.append(sum(n for n, _ in lists))
                tokens.append(sum(n for _, n in lists))
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """Pieces of a byte-level vocabulary; those with a space in front begin a word, and single bytes cover the rest."""
    import public_tokenizers

    pieces = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces, pieces)
