"""Collocations, vector codes and document fingerprints against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, fingerprints, vector_codes

# --- collocations


def brute_phrases(rows, least, longest, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    subsumed = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = lang, p[i : i + k]
                if 100 * a >= percent * candidates[part]:
                    subsumed.add(part)
    found = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in subsumed:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in found.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])}


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(8)
    fixed = ["new york city hall", "éa Éa", "in the end", "x y", "of the", "a b c d e f"]
    texts = []
    for i in range(240):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice("abcdxyz") + rng.choice(["", "q"]) for _ in range(rng.randint(1, 5))))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x85", " ", "!?", " \x1c "]))
        texts.append((rng.choice(["en", "en", "de", None, "und"]), "".join(parts).title() if i % 9 == 0 else "".join(parts)))
    return texts + [("en", None), ("en", ""), ("fr", " \t\n"), ("zz", "one"), (None, "of the")] + texts[:3] + [("en", "loop " * 40_000)]


def phrase_docs(spark, rows):
    schema = "doc_id long, lang string, text string, words string, prefix int, n long, phrase string"
    return spark.createDataFrame([(i, lang, t, "w", 1, 2, None) for i, (lang, t) in enumerate(rows)], schema)


@pytest.mark.parametrize("least, longest, percent, top", [(30, 4, 80, 2000), (5, 3, 50, 7), (2, 5, 100, 50), (3, 2, 80, 10)])
def test_collocations(spark, phrase_rows, monkeypatch, least, longest, percent, top):
    monkeypatch.setattr(collocations, "_HELD", 500)
    docs = phrase_docs(spark, phrase_rows).repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least, longest, percent, top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(phrase_rows, least, longest, percent, top)


def test_stripes_of_small_flushes(phrase_rows):
    """Many flushes, and parts merged bit by bit, give the counts of one."""
    whole = Counter()
    for size in (50, 10**9):
        counter, found = collocations._Counter([1], 7, None, None), Counter()
        for lang, text in phrase_rows:
            counter.add(lang or "und", (text or "").encode())
            if counter.held > size:
                for batch in counter.flush():
                    for part, name, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        found.update({(part, name, r["word"]): r["n"] for r in collocations._unpack(value).to_pylist()})
        for batch in counter.flush():
            for part, name, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for r in collocations._unpack(value).to_pylist():
                    found[part, name, r["word"]] += r["n"]
        whole = whole or found
        assert found == whole


def test_no_collocations(spark, phrase_rows):
    docs = phrase_docs(spark, phrase_rows)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text is null or lang = 'fr'")).count() == 0
    assert collocations.collocations(docs, max_words=1).count() == 0


def test_filter_of_members():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64)
    size = 1 << 17
    bits = np.zeros(size // 8, np.uint8)
    for place in collocations.Members.places(hashes, size):
        np.bitwise_or.at(bits, place >> np.uint64(3), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    members = collocations.Members(bits)
    others = rng.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64)
    assert members.of(hashes).all() and members.of(others).mean() < 0.02


# --- vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[int(np.floor(scale * float(x))) for x in r[1]] for r in rows]
    width = len(v[0]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in v]
    books = [[cut[i][p] for i in range(min(entries, len(v)))] for p in range(parts)]
    nearest = lambda part, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[part]))
    for turn in range(rounds + 1):
        found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x[p] for x, f in zip(cut, found) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(r[0]), str(r[2]), [f[p][1] for p in range(parts)], sum(f[p][0] for p in range(parts))) for r, f in zip(rows, found)), books


VECTORS = "vec_id long, embedding array<float>, label int, vec string, near int, error string"


def vector_rows(rng, n, width, spread=1.0):
    centres = rng.normal(size=(12, width)) * spread
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=width) * 0.05], int(i % 5) if i % 4 else None) for i in rng.permutation(n)]
    rows += rows[:6]  # repeated rows
    rows += [(rows[0][0], rows[1][1], 3), (None, rows[2][1], None), (n + 1, None, 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] + [0.0] * (width - 1), 1), (n + 4, [None] + [0.0] * (width - 1), 2)]
    return rows + [(n + 5 + i, [0.0] * width, None) for i in range(9)]  # ties


@pytest.mark.parametrize("n, width, entries, closest, scale", [(300, 8, 16, 4, 1024.0), (300, 8, 16, 2, 1024.0), (150, 4, 40, 16, 8.0), (20, 8, 256, 16, 1024.0), (200, 8, 16, 3, 2.0**22)])
def test_vector_codes(spark, monkeypatch, n, width, entries, closest, scale):
    monkeypatch.setattr(vector_codes, "CLOSEST", closest)
    rows = vector_rows(np.random.default_rng(n + closest), n, width)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    codes, books = vector_codes.vector_codes(table, entries=entries, scale=scale)
    got = sorted((str(r["vec_id"]), str(r["label"]), r["codes"], r["error"]) for r in codes.collect())
    want, entries_want = brute_codes(rows, 4, entries, 4, scale)
    assert books.entries.tolist() == entries_want
    assert got == want


def test_code_digests(spark):
    rows = vector_rows(np.random.default_rng(5), 60, 8)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)
    got = vector_codes.code_digests(table).collect()
    want, books = brute_codes(rows, 4, 256, 4, 1024.0)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((i, "".join(f"{c:02x}" for c in codes), e) for i, _, codes, e in want)
    by = Counter()
    for _, label, _, error in want:
        by[label] += error
    assert sorted(r["label_error"] for r in got) == sorted(by[label] for _, label, _, _ in want)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()}
    assert vector_codes.code_digests(table.where("false")).count() == 0
    assert vector_codes.code_digests(table.where("embedding is null")).count() == 0
    codes, found = vector_codes.vector_codes(table)
    back = {r["vec_id"]: r["vec"] for r in vector_codes.decoded(codes, found).where("vec_id = 7").collect()}
    one = next(r for r in codes.where("vec_id = 7").collect())
    assert back[7] == [x for p, c in enumerate(one["codes"]) for x in found.entries[p][c].tolist()]


def test_vectors_that_cannot_be_cut(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0] * 4), (2, [1.0] * 8)], [(1, [3e30] * 4)]):
        with pytest.raises(Exception, match="must|too large|overflow"):
            vector_codes.code_digests(spark.createDataFrame([(*r, None, "x", 1, "y") for r in rows], VECTORS)).count()
    got = vector_codes.code_digests(spark.createDataFrame([(1, [], 1, "x", 1, "y")], VECTORS)).first()
    assert (got["code"], got["error"]) == ("00000000", 0)


# --- fingerprints


def brute_digest(text):
    data, counts = text.encode(), [0] * fingerprints.BUCKETS
    mask = 0xFFFFFFFF
    for kind, (a, b, c) in enumerate(fingerprints._TRIPLETS):
        for i in range(len(data) - c):
            h = data[i + a] << 16 | data[i + b] << 8 | data[i + c]
            h = ((h + (kind << 24)) & mask) * 2654435761 & mask
            h = (h ^ h >> 15) * 2246822519 & mask
            counts[(h ^ h >> 13) % fingerprints.BUCKETS] += 1
    low, middle, high = (sorted(counts)[fingerprints.BUCKETS * i // 4 - 1] for i in (1, 2, 3))
    out = bytes([min(255, int(8 * np.log2(len(data) + 1))), min(15, 16 * low // max(1, high)) << 4 | min(15, 16 * middle // max(1, high))])
    q = [(x > low) + (x > middle) + (x > high) for x in counts]
    return out + bytes(q[i] << 6 | q[i + 1] << 4 | q[i + 2] << 2 | q[i + 3] for i in range(0, len(q), 4))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    score = 2 * abs(a[0] - b[0]) + 4 * abs((a[1] >> 4) - (b[1] >> 4)) + 4 * abs((a[1] & 15) - (b[1] & 15))
    for x, y in zip(a[2:], b[2:]):
        score += sum((0, 1, 2, 6)[abs((x >> s & 3) - (y >> s & 3))] for s in (6, 4, 2, 0))
    return 1 - min(score, 384) / 384


def brute_edited(rows):
    """rows in descending order."""
    out = []
    for i, (k, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(brute_digest, (text, edited, after))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), brute_likeness(a, b), brute_likeness(a, c)))
    return out


PRINTS = "doc_id long, text string, fingerprint int, _part string, n_chars long"


def print_rows():
    rng = random.Random(2)
    texts = ["", None, "a", "ab", "abc", "😀é日本" * 3, "same text " * 20, "same text " * 20]
    texts += ["".join(rng.choice("abcdefgh  é") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    return [(7 * i - 50, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("parts, dealt", [("1", 1), ("4", 3), ("64", 5)])
def test_edited_fingerprints(spark, parts, dealt):
    rows = print_rows()
    table = spark.createDataFrame([(*r, 1, "x", None) for r in rows], PRINTS).repartition(dealt)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(tuple(r) for r in fingerprints.edited_fingerprints(table).collect())
        assert got == sorted(brute_edited(sorted(rows, reverse=True)))
        one = fingerprints.edited_fingerprints(table.where("doc_id = 6")).collect()
        assert [tuple(r) for r in one] == brute_edited([r for r in rows if r[0] == 6])
        assert fingerprints.edited_fingerprints(table.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_of_odd_ids(spark):
    rows = [(None, "first of all"), (3, "x" * 50), (3, "y" * 60), (1, "tail"), (1, "tail")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(*r, 1, "x", None) for r in rows], PRINTS)).collect()
    assert sorted(str((r["doc_id"], r["n_chars"])) for r in got) == sorted(str((i, len(t))) for i, t in rows)
    middle = sorted(r for r in rows if r[0] == 3)
    orders = [[rows[0], *m, rows[3], rows[4]] for m in (middle, middle[::-1])]
    assert {tuple(r) for r in got} in [set(brute_edited(o)) for o in orders]
    named = spark.createDataFrame([("b", "text b" * 9), ("a", "text a" * 5), ("c", None)], "doc_id string, text string")
    assert sorted(tuple(r) for r in fingerprints.edited_fingerprints(named).collect()) == sorted(brute_edited([("c", None), ("b", "text b" * 9), ("a", "text a" * 5)]))


def test_likeness(spark):
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(2_500_000))
    assert fingerprints.digest(long) == brute_digest(long)  # counted in pieces
    table = spark.createDataFrame([(1, "x y z " * 30, 0, "", 0), (2, "x y z " * 29 + "w", 0, "", 0), (3, None, 0, "", 0)], PRINTS)
    prints = fingerprints.fingerprints(table)
    assert {r["doc_id"]: r["n_chars"] for r in prints.collect()} == {1: 180, 2: 175, 3: 0}
    other = prints.select(F.col("doc_id").alias("other"), F.col("fingerprint").alias("second")).unionByName(spark.createDataFrame([(4, None)], "other long, second string"))
    pairs = prints.where("doc_id = 1").crossJoin(other)
    got = {r["other"]: r["like"] for r in pairs.select("other", fingerprints.fingerprint_likeness(F.col("fingerprint"), F.col("second")).alias("like")).collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and got[3] < got[2] and got[4] is None


@pytest.mark.parametrize("name", ["collocations", "vector_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    module = {"collocations": collocations, "vector_codes": vector_codes}[name]
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(module.SQL).fetchdf()
    got = module.query(spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
