"""A SentencePiece BPE model file read without the library: normalizer, merges, spans and decoding.

The file is a protocol buffer: field 1 repeats a piece (1 text, 2 score, 3 type), field 2 holds the trainer's options
and field 3 the normalizer's (2 compiled character map, 3 add a dummy prefix, 4 remove extra white space, 5 escape it).
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np

from tessera.llm.memo import Memo

SPACE = "▁"
# Fixed values of the file format: types of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2
_LONG = 48
_NONE = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, number()
        else:
            size = number() if wire == 2 else {1: 8, 5: 4}[wire]
            yield field, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched by the longest prefix of data[at:] in the map and what replaces them."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (end + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)]


class PieceModel:
    """Encoding and decoding of one model file's contents."""

    def __init__(self, data: bytes, memo: int = 200_000):
        pieces, self.add_prefix, self.trim, self.escape, charsmap, kind, byte_fallback = [], True, True, True, b"", 1, False
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
                kind, byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
                if trainer.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif field == 3:
                rules = dict(_fields(value))
                charsmap, self.add_prefix = rules.get(2, b""), bool(rules.get(3, 1))
                self.trim, self.escape = bool(rules.get(4, 1)), bool(rules.get(5, 1))
        if kind != _BPE or not byte_fallback or any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
        self.map = CharacterMap(charsmap) if charsmap else None
        self.types = [t for _, _, t in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.scores = {p: s for p, s, t in pieces if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        special = {p: i for i, (p, _, t) in enumerate(pieces) if t == CONTROL}
        self.bos, self.eos = special["<s>"], special["</s>"]
        self.surfaces = [
            b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, t in pieces
        ]
        self.opens = [t == NORMAL and p.startswith(SPACE) for p, _, t in pieces]
        longer = [p for p in self.ids if len(p) > 1]
        # A piece with a space after another character would join two words, and words could not be encoded apart.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in longer)
        inner = "".join(re.escape(c) for c in sorted({c for p in longer for c in p} - {SPACE}))
        self.chunks = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|." if self.apart and inner else ".+", re.DOTALL)
        self.memo = Memo(self._encode_chunk, memo)

    # Normalization -------------------------------------------------------------------------------------------------

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalized text, and for each of its characters and its end the byte of text's UTF-8 where it begins."""
        if self.map is None and not self.trim:
            return self._identity(text)
        data = text.encode()
        out, starts, at = [], [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit:
                size, replaced = hit[0], hit[1].decode()
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                replaced = data[at : at + size].decode()
            out.extend(replaced)
            starts.extend([at] * len(replaced))
            at += size
        end = len(data)
        if self.trim:
            kept = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while kept and out[kept[-1]] == " ":
                end = starts[kept.pop()]
            out, starts = [out[i] for i in kept], [starts[i] for i in kept]
        if not out:
            return "", np.zeros(1, np.int64)
        if self.add_prefix:
            out.insert(0, " ")
            starts.insert(0, starts[0])
        joined = "".join(out)
        return joined.replace(" ", SPACE) if self.escape else joined, np.array([*starts, end], np.int64)

    def _identity(self, text: str) -> tuple[str, np.ndarray]:
        """normalize() where the map is empty and white space is kept."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = text.encode()
        if len(data) == len(text):
            starts = np.arange(len(data) + 1)
        else:
            raw = np.frombuffer(data, np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))
        normal = text.replace(" ", SPACE) if self.escape else text
        if self.add_prefix:
            normal, starts = (SPACE if self.escape else " ") + normal, np.insert(starts, 0, 0)
        return normal, starts

    # Encoding ------------------------------------------------------------------------------------------------------

    def _merge(self, chars: list[str]) -> list[str]:
        """Merge the pair of the best score, the leftmost of equal ones, until no pair is a piece."""
        scores = self.scores
        if len(chars) > _LONG:
            return self._merge_long(chars)
        get = scores.get
        gains = [get(pair, _NONE) for pair in map(add, chars, chars[1:])]
        while gains and (best := max(gains)) > _NONE:
            at = gains.index(best)
            chars[at : at + 2] = [chars[at] + chars[at + 1]]
            del gains[at]
            if at < len(gains):
                gains[at] = get(chars[at] + chars[at + 1], _NONE)
            if at:
                gains[at - 1] = get(chars[at - 1] + chars[at], _NONE)
        return chars

    def _merge_long(self, chars: list[str]) -> list[str]:
        """_merge() with a heap of pairs, for long runs of characters."""
        scores, n = self.scores, len(chars)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def push(left: int) -> None:
            right = after[left]
            if left >= 0 and right >= 0 and (score := scores.get(pair := chars[left] + chars[right])) is not None:
                heapq.heappush(heap, (-score, left, right, pair))

        for i in range(n - 1):
            push(i)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if after[left] != right or not chars[left] or chars[left] + chars[right] != pair:
                continue
            chars[left], chars[right] = pair, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            after[right] = -1
            push(left)
            if before[left] >= 0:
                push(before[left])
        return [c for c in chars if c]

    def _encode_chunk(self, chunk: str) -> bytes:
        """A 64-bit number for each id: the id and, above it, the characters of its piece.

        Of the bytes that stand for one character, the first has the character.
        """
        pieces = self._merge(list(chunk))
        ids, sizes = list(map(self.ids.get, pieces)), list(map(len, pieces))
        if None in ids:
            ids, sizes = [], []
            for piece in pieces:
                known = self.ids.get(piece)
                found = [known] if known is not None else [self.bytes[b] for b in piece.encode()]
                ids += found
                sizes += [len(piece)] + [0] * (len(found) - 1)
        return array("Q", [i | n << 32 for i, n in zip(ids, sizes)]).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids between the begin and end ids, and the byte span of the text that each came from.

        The dummy prefix takes no bytes. The bytes of a character that no piece holds share its span. The begin id is
        at byte 0 and the end id at the last, both empty.
        """
        normal, starts = self.normalize(text)
        both = np.frombuffer(b"".join(self.memo.of(self.chunks.findall(normal))), "<u4").reshape(-1, 2)
        ids, sizes = both[:, 0], both[:, 1]
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - sizes
        tail = np.flatnonzero((sizes == 0))
        for i in tail:  # a further byte of the same character begins where its first byte does
            begins[i] = begins[i - 1]
        last = int(starts[-1])
        return (
            np.concatenate([[self.bos], ids, [self.eos]]).astype("<u4"),
            np.concatenate([[0], starts[begins], [last]]),
            np.concatenate([[0], starts[ends], [last]]),
        )

    # Decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; one space that opens the first piece goes, as it came from the dummy prefix."""
        ids = ids.tolist()
        data = b"".join(map(self.surfaces.__getitem__, ids))
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        if first is not None and self.opens[first] and (self.add_prefix or self.trim):
            data = data[1:]
        return data.decode(errors="replace")
