"""Words of a text: runs of bytes other than space and 0x09-0x0D, read in bounded pieces; and rolling hashes of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

#: The same words as a pattern of java.util.regex and re.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PIECE = 1 << 19
_U = np.uint64
#: The base of the rolling hashes: odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data in order, in lists of about size bytes, so that a very long text needs no list of all words."""
    for start, end in _cuts(data, size):
        yield data[start:end].split()


def _cuts(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Parts of about size bytes that no word crosses."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, start + size) if start + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield start, end
        start = end


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        values = np.full(size, base, _U)
        values[0] = 1
        found.append(np.multiply.accumulate(values))
    return found[0], found[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the symbols of each run, from sums of symbol times power over all symbols before."""
    count = len(symbols)
    power, inverse = powers(max(_PIECE, 1 << count.bit_length()))
    sums = np.zeros(count + 1, _U)
    np.cumsum(symbols.astype(_U) * power[:count], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of data, and the place of its first byte."""
    hashes, places = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for start, end in _cuts(data, _PIECE):
        symbols = np.frombuffer(data, np.uint8, end - start, start)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_IS_SPACE[symbols], [False]])))
        hashes.append(run_hashes(symbols, edges[::2], edges[1::2]))
        places.append(edges[::2] + start)
    return np.concatenate(hashes), np.concatenate(places)


def hashed_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, one text after the other, and how many each text has."""
    parts = [(t or "").encode().lower() for t in texts]
    hashes, places = hashed_words(b"\n".join(parts))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(places, begins))
