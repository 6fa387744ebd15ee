"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text is built. A text is parsed greedily: each phrase is the longest
match in the automaton, a symbol that does not occur is a phrase of its own. The language that needs the fewest
phrases per symbol wins.

Transitions are tables of (state, symbol) -> next state, dense for the commonest symbols and a sorted array for all
others, so that every character of the samples is a symbol of its own, whatever the scripts; a missing transition begins
a new phrase. numpy advances all blocks of a batch of texts by one symbol at a time. A block of a text is first parsed as if
a phrase began with it, and then again from where the block before it really ends, until both parses are in one state,
mostly after a few symbols; so phrases don't depend on blocks, and a very long text needs no more memory than others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each language that are read for fitting, at most, and the characters that are kept of them.
FIT_DOCS, FIT_CHARS = 60, 12_000
#: Languages that are learned, at most: those with the most labelled documents, the first in byte order of equal ones.
FIT_LANGS = 500
#: Symbols of a block, and symbols that one numpy pass holds.
BLOCK, _PASS = 512, 1 << 22
#: Symbols up to this many have a table of (state, symbol); more are looked up in a sorted array.
_DENSE = 64
UNKNOWN = "und"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings of symbols; state 0 is the start."""
    follow, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        state = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in follow[at]:
            follow[at][symbol] = state
            at = link[at]
        if at != -1:
            target = follow[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at != -1 and follow[at].get(symbol) == target:
                    follow[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return follow


class CrossParser:
    """Counts phrases of texts in the automata of several languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = {lang: samples[lang].lower() for lang in self.languages}
        common = [c for c, _ in Counter("".join(folded.values())).most_common()]
        #: Symbol of each code point: 0 fills the last block, 1 stands for all that is in no sample.
        self.symbols = np.ones(0x110000, np.int32)
        for i, c in enumerate(common):
            self.symbols[ord(c)] = i + 2
        self.width = min(_DENSE, len(common) + 2)
        self.tables, self.starts, self.firsts, rare, base = [], [], [], [], 0
        for lang in self.languages:
            follow = suffix_automaton(self._symbols(folded[lang]).tolist())
            # The last state is where no phrase is open: at the beginning, and after a symbol that does not occur.
            closed = len(follow)
            table = np.full((closed + 1, self.width), -1, np.int64)
            for state, to in enumerate(follow):
                for symbol, target in to.items():
                    if symbol < self.width:
                        table[state, symbol] = target
                    else:
                        rare.append((base + state, symbol, base + target))
            # A missing transition begins a phrase, which the symbol opens, or is if it does not occur.
            missing = table < 0
            table = (base + np.where(missing, np.where(table[0] < 0, closed, table[0]), table)) * 2 + missing
            table[:, 0] = (base + np.arange(closed + 1)) * 2  # the filler changes nothing
            self.tables.append(table.astype(np.int32))
            self.starts.append(base + closed)
            first = np.full(len(common) + 2, base + closed, np.int32)
            first[list(follow[0])] = base + np.array(list(follow[0].values()), np.int32)
            self.firsts.append(first)
            base += closed + 1
        self.table = np.concatenate(self.tables).reshape(-1)
        del self.tables
        rare = np.array(rare, np.int64).reshape(-1, 3)
        keys = rare[:, 0] << 21 | rare[:, 1]
        order = np.argsort(keys)
        self.keys, self.targets = np.append(keys[order], 1 << 62), np.append(rare[order, 2], 0).astype(np.int32)

    def _symbols(self, folded: str) -> np.ndarray:
        return self.symbols[np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _step(self, state: np.ndarray, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Twice the next state of each, and 1 more where a phrase begins."""
        if self.width == len(first):
            return self.table[state * self.width + symbol]
        step = self.table[state * self.width + np.minimum(symbol, self.width - 1)]
        at = np.flatnonzero(symbol >= self.width)
        if len(at):
            key = state[at].astype(np.int64) << 21 | symbol[at]
            place = np.searchsorted(self.keys, key)
            step[at] = np.where(self.keys[place] == key, self.targets[place] * 2, first[symbol[at]] * 2 + 1)
        return step

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the symbols of each text."""
        counts, sizes = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        blocks, owners, first, before = [], [], [], np.array(self.starts, np.int32)

        def flush() -> None:
            nonlocal blocks, owners, first, before
            if blocks:
                found, before = self._parse(np.stack(blocks), np.array(first), before)
                np.add.at(counts, np.array(owners), found)
            blocks, owners, first = [], [], []

        for i, text in enumerate(texts):
            symbols = self._symbols(text.lower())
            sizes[i] = len(symbols)
            for start in range(0, len(symbols), BLOCK):
                part = symbols[start : start + BLOCK]
                blocks.append(part if len(part) == BLOCK else np.pad(part, (0, BLOCK - len(part))))
                owners.append(i)
                first.append(start == 0)
                if len(blocks) * BLOCK >= _PASS:
                    flush()
        flush()
        return counts, sizes

    def _parse(self, blocks: np.ndarray, first: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, and the states after the last one, in each language.

        Blocks follow one another but for those that are the first of their text; before has the states before the first block of all.
        """
        lengths = np.count_nonzero(blocks, axis=1)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(blocks[order].T)
        place = np.empty(len(blocks), np.int64)  # of a block among the columns
        place[order] = np.arange(len(blocks))
        # Blocks that have ended lie behind the others and are left out.
        running = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")
        found, after = np.empty((len(blocks), len(self.languages)), np.int64), before.copy()
        states, begins = np.empty(columns.shape, np.int32), np.zeros(columns.shape, bool)
        for k, start in enumerate(self.starts):
            state = np.full(len(blocks), start, np.int32)
            for at in range(BLOCK):
                n = running[at]
                if not n:
                    break
                step = self._step(state[:n], columns[at, :n], self.firsts[k])
                begins[at, :n] = step & 1
                state[:n] = states[at, :n] = step >> 1
            entered = np.full(len(blocks), start, np.int32)
            while True:
                last = states[lengths - 1, place]
                truly = np.where(first, start, np.concatenate([before[k : k + 1], last[:-1]]))
                lanes = np.flatnonzero(truly != entered)
                if not len(lanes):
                    break
                entered[lanes] = truly[lanes]
                self._again(columns, states, begins, lengths[lanes], place[lanes], truly[lanes], self.firsts[k])
            after[k] = last[-1]
            found[order, k] = begins.sum(axis=0)
            begins[:] = False
        return found, after

    def _again(self, columns: np.ndarray, states: np.ndarray, begins: np.ndarray, lengths: np.ndarray, lanes: np.ndarray, state: np.ndarray, first: np.ndarray) -> None:
        """Parse the columns `lanes` from other states, up to where they are in the same state as before."""
        for at in range(BLOCK):
            here = lengths > at
            if not here.all():
                lengths, lanes, state = lengths[here], lanes[here], state[here]
            if not len(lanes):
                return
            step = self._step(state, columns[at, lanes], first)
            state = step >> 1
            differs = states[at, lanes] != state
            states[at, lanes], begins[at, lanes] = state, step & 1
            lengths, lanes, state = lengths[differs], lanes[differs], state[differs]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: 1 less the phrases per symbol of the best language.

        The first in alphabetical order of equal ones; (UNKNOWN, 0.0) for null and for texts without letters.
        """
        counts, sizes = self.phrases([t or "" for t in texts])
        best = counts.argmin(axis=1)
        return [
            (self.languages[b], float(max(0.0, 1 - c[b] / max(1, n)))) if t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0)
            for t, b, c, n in zip(texts, best, counts, sizes)
        ]


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def learning_sample(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", fit_docs=FIT_DOCS, fit_chars=FIT_CHARS, fit_langs=FIT_LANGS) -> dict[str, str]:
    """Text of each language: at most fit_docs documents, those of the least hashes of their ids, fit_chars characters;
    of at most fit_langs languages, those with the most documents.

    Documents with a null id, text or language, and those whose crc32(id) leaves 2 modulo 4, are not learned from.
    """
    ids = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = ids.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(~_held_out("id"))
    langs = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_langs).select("lang")
    ids = ids.join(F.broadcast(langs), "lang")  # fit_langs rows
    ranked = ids.selectExpr("id", "lang", "row_number() over (partition by lang order by xxhash64(id), id) as rank").where(F.col("rank") <= fit_docs)
    picked = F.broadcast(ranked.select("id", "lang"))  # fit_docs rows for each language
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(picked, ["id", "lang"])
    texts: dict[str, list[str]] = {}
    for row in rows.select("lang", "id", F.substring("text", 1, fit_chars).alias("text")).orderBy("lang", F.xxhash64("id"), "id", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    share = {lang: -(-fit_chars // len(parts)) for lang, parts in texts.items()}
    return {lang: _balanced(parts, share[lang], fit_chars) for lang, parts in texts.items()}


def _balanced(parts: list[str], share: int, limit: int) -> str:
    """An equal share of each part, or all of them if they are short; `limit` characters, separators included."""
    return "\n".join(p[: max(share, 1)] if sum(map(len, parts)) > limit else p for p in parts)[:limit]


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, held_out, lang_pred, score (0 to 1).

    Null and repeated ids are kept as rows; a null id is not held out. Only the text decides the prediction; a null
    text, or one without letters, is UNKNOWN with score 0, and so is every text if there are no samples. Other columns
    are ignored. The samples, of bounded size, are broadcast, and each Python worker builds the automata once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = _parser(shared.value).predict(texts) if shared.value else [(UNKNOWN, 0.0)] * len(texts)
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), langs, scores], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), _held_out(id_col).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learning_sample(docs))
