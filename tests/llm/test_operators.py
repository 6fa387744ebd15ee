"""Each operator against a brute-force version, on rows with nulls, empty and repeated texts and clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, line_dedup, line_prints, quality_rules, sentence_pieces, simhash_dedup, source_mix, substring_dedup, token_counts, warc
from tessera.llm.components import connected_components
from tessera.llm.piece_model import CharacterMap, PieceModel
from tessera.llm.scratch import Scratch
from tessera.llm.words import BASE, hashed_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, n_words long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = words(rng, 120)
    long = "\n".join(words(rng, 12) for _ in range(400))
    return [None, "", "", "   \n\t", "one", "two words", base, base, base, base + " tail", base.replace("a", "b", 1), long, long, words(rng, 60) + " " + base[:400], "é ß 日本 😀", words(rng, 30), None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 5 else None, t, None if i % 5 == 0 else "xx", None if i % 7 == 0 else f"s{i % 3}", None, 1, "n", 2) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 1), (9, 8), (8, 7), (7, 6), (5, 5), (None, 4), (20, 11), (11, 12), (12, 13)], "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 11: 11, 12: 11, 13: 11, 20: 11}
    assert connected_components(edges.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hasher", [None, lambda b: F.length(b).cast("long")], ids=["xxhash64", "clashing"])
def test_exact_dedup(docs, hasher):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    extra = {"hasher": hasher} if hasher else {}
    named = exact_dedup.name_documents(docs, block_bytes=64, **extra).collect()
    assert len(named) == len(rows)
    by = {}
    for r in named:
        by.setdefault((r["level"], r["name"]), set()).add(r["text_sha256"])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({t for _, t in rows})


def test_exact_dedup_rows(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = exact_dedup.exact_dedup(docs, block_bytes=256).collect()
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"] and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i, t in rows if t == text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len({t for _, t in rows})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_warc(spark):
    rng = random.Random(1)
    same = words(rng, 300)
    rows = [(1, "http://a/ü b", same), (2, None, same), (3, "u", ""), (4, "u", None), (5, "u\r\nX: y", "x" * 300_000), (None, "n", same), (7, "v", "q\r\n\r\nq"), (2, None, same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2), (7, "response", None), (2, "revisit", 2)]
    assert got == sorted(((i, len((t or "").encode()), sha(t), kind, to) for (i, _, t), (_, kind, to) in zip(rows, want)), key=str)
    short = warc.archive_round_trip(pages, min_bytes=1).where("page_id in (3, 4)").collect()
    assert {r["record_type"] for r in short} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_tells_rows_of_one_page_apart(spark):
    rows = [(5, "u", "aaa", 1), (5, "u", "bbbbb", 2), (3, "v", "aaa", 3), (3, "w", "bbbbb", 4), (None, "x", "c", 5), (None, "y", "c", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long").withColumn("row", F.lit(1)).withColumn("number", F.lit("z"))
    got = [tuple(r) for r in warc.archive_round_trip(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(5, 3, "response", None), (5, 5, "response", None), (3, 3, "revisit", 5), (3, 5, "revisit", 5), (None, 1, "response", None), (None, 1, "revisit", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


class Trickle(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, size=-1):
        return super().read(min(size, 7))


def test_warc_reader_rejects_damage():
    good = warc.record_bytes("<urn:page:1:1>", "u", b"payload\r\n\r\nx" * 900, None, "2024-01-01T00:00:00Z", 6)
    for stream in (io.BytesIO, Trickle):
        assert [r.payload for r in warc.records(stream(good + good))] == [b"payload\r\n\r\nx" * 900] * 2
        assert [(r.size, r.payload) for r in warc.records(stream(good), keep_payload=False)] == [(900 * 12, None)]
        plain = zlib.decompress(good, 31)
        bad = [plain.replace(b"payload", b"pAyload"), plain[:-4], plain + b"\r\n", plain.replace(b"Content-Length: ", b"Content-Length: 1"), b"x" + plain, b""]
        for data in bad:
            with pytest.raises(ValueError):
                list(warc.records(stream(gzip.compress(data))))
        for kept in (1, 5, 12, 20, 40, 80, len(good) - 9, len(good) - 1):
            with pytest.raises(ValueError):
                list(warc.records(stream(good + good[:kept])))
        with pytest.raises(ValueError):
            list(warc.records(stream(good + b"no gzip")))
    assert list(warc.records(io.BytesIO(b""))) == []


def greedy(word, starting, continuing):
    count, at, have = 0, 0, starting
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in have), None)
        if end is None:
            return 1
        count, at, have = count + 1, end, continuing
    return count


def test_longest_match():
    rng = random.Random(2)
    some = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
    for _ in range(60):
        starting, continuing = some(), some()
        machine = token_counts.LongestMatch(starting, continuing)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert machine.count(word) == greedy(word, starting, continuing)


def test_token_counts(docs, empty):
    vocabulary = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"cd", b"one", b" o"]
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = token_counts.token_counts(docs, vocabulary, vocabulary).collect()
    have = {(i, len((t or "").encode().split()), sum(greedy(b" " + w, set(vocabulary), set(vocabulary)) for w in (t or "").encode().split())) for i, t in rows}
    assert {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in got} == have and len(got) == docs.count()
    assert token_counts.token_counts(empty, vocabulary, vocabulary).count() == 0


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {x for p in places.values() if len(p) > 1 for i in p for x in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, docs, empty):
    rng = random.Random(3)
    block = words(rng, 9)
    more = [(100, f"{block} x {block} {block}", None), (101, "a b " * 30 + "\n#x\n#x\n \n", None), (102, words(rng, 25) + " | " + block, None)]
    docs = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame(more, "doc_id long, text string, n_words long"))
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, None), (13, 0, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got} == {(i, *rules(t)) for i, t in rows}
    assert len(got) == docs.count() and not any(r["kept"] and r["base_failed"] for r in got)
    weights = quality_rules.fit_weights(docs, labels)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        w = [x.lower() for x in WORD.findall(text or "")]
        bucket = lambda *g: _chained(g) % quality_rules.BUCKETS
        grams = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]
        assert (r["n_grams"], r["score_sum"]) == (len(grams), sum(weights[g] for g in grams))
    assert sorted(quality_rules.passing(docs, labels).columns) == sorted(docs.columns)
    assert quality_rules.quality_rules(empty, labels).count() == 0


def _chained(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def simhash(text, size=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    counts = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        counts += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def second_print(text, size=5):
    """simhash() of other hashes of the same shingles."""
    mask = (1 << 64) - 1
    w = [x.encode() for x in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    total = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42) ^ BASE
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor & mask
        h ^= h >> 33
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(grams)) if grams else 0


def near_prints(prints, seconds, i, j):
    """Whether two fingerprints are near enough for their texts to be compared."""
    bits = (prints[i] ^ prints[j]).bit_count()
    return bits <= simhash_dedup.RADIUS and bits + (seconds[i] ^ seconds[j]).bit_count() <= simhash_dedup.BOTH


def grouped(prints, ids, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [simhash(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, grouped(prints, [i for i, _ in rows], 2))), key=str)
    got = simhash_dedup.simhash_groups(docs).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert simhash_dedup.simhash_groups(empty).count() == 0


def set_of(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_simhash_dedup(spark, docs, empty):
    rng = random.Random(18)
    base = [words(rng, 150).split() for _ in range(4)]
    rows = []
    for k, text in enumerate(base):
        for changed in (0, 1, 2, 3, 60):
            other = text[:]
            for i in rng.sample(range(150), changed):
                other[i] = words(rng, 1) + "z"
            rows.append((500 - 10 * k + changed, " ".join(other), "x"))
    more = docs.select("doc_id", "text", F.lit("y").alias("fp")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    for table in (more, spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)):
        data = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: (r[0] is None, r[0] or 0))
        prints, sets = [simhash(t, 5) for _, t in data], [set_of(t, 5) for _, t in data]
        seconds = [second_print(t) for _, t in data]
        parent = list(range(len(data)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(data)):
            for j in range(i):
                near = near_prints(prints, seconds, i, j)
                if near and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        got = simhash_dedup.simhash_dedup(table)
        assert got.columns == ["doc_id", "text", "fp"]
        ids = [i for i, _ in data if i is not None]
        assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(d for i, (d, _) in enumerate(data) if d is not None and find(i) == i)
        assert got.count() == sum(find(i) == i for i in range(len(data))) < len(ids)
    assert simhash_dedup.simhash_dedup(empty).count() == 0


def test_texts_of_one_fingerprint(spark):
    """Similar texts are found where their nearest neighbours aren't similar: all three have the fingerprint of what they repeat."""
    rng = random.Random(21)
    often, end, other = words(rng, 11), words(rng, 60).split(), words(rng, 60)
    near = " ".join(end[:30] + ["zz"] + end[31:])
    rows = [(1, f"{often} " * 100 + other), (2, f"{often} " * 100 + " ".join(end)), (3, f"{often} " * 100 + near)]
    assert len({simhash(t, 5) for _, t in rows}) == 1
    got = simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == [1, 2]


def test_least_hashes():
    """Texts of the similarity have one of the least hashes of their shingles in common; unrelated ones, which are not compared, have none."""
    rng = random.Random(22)
    for size in [1, 2, 3, 4, 5, 6, 9, 10, 11, 40, 41, 200]:
        for _ in range(40):
            one = [rng.getrandbits(64) for _ in range(size)]
            lost = rng.randint(0, size // 4)
            two = one[lost:] + [rng.getrandbits(64) for _ in range(rng.randint(0, size // 5))]
            a, b = (simhash_dedup._least([np.array(x, np.uint64)], 0.8).tolist() for x in (one, two))
            if len(set(one) & set(two)) >= 0.8 * len(set(one) | set(two)):
                assert set(a) & set(b)
    keys = []
    for _ in range(200):
        seen = []
        simhash_dedup._prints(words(rng, 80), 5, True, seen)
        keys += simhash_dedup._least(seen, 0.8).tolist()
    assert len(keys) == len(set(keys)) == 200 * 16


@pytest.mark.parametrize("few, run, tile", [(90, 1 << 14, 2048), (4, 1 << 14, 7), (2, 20, 5)])
def test_checked_links(spark, monkeypatch, few, run, tile):
    """What the links that stand the check connect, by brute force, also where the nearest links don't."""
    for name, value in (("_FEW", few), ("_RUN", run), ("FAR_TILE", tile)):
        monkeypatch.setattr(simhash_dedup, name, value)
    rng = random.Random(23)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    heads = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(6)]
    rows = [(i, flip(a, rng.randint(0, 9)), flip(b, rng.randint(0, 9)), rng.sample(range(8), rng.randint(1, 3))) for i in range(90) for a, b in [heads[i * i % 6]]]
    found = spark.createDataFrame([(i, signed(a), signed(b), [*keys, 200 + i]) for i, a, b, keys in rows], "row long, fp long, fp2 long, keys array<long>").repartition(3)
    prints, seconds = [r[1] for r in rows], [r[2] for r in rows]
    near = {(i, j) for i in range(90) for j in range(i + 1, 90) if set(rows[i][3]) & set(rows[j][3]) and near_prints(prints, seconds, i, j)}

    def roots(pairs):
        to = list(range(90))
        for i, j in pairs:
            a, b = sorted((to[i], to[j]))
            to = [a if x == b else x for x in to]
        return to

    for check, passes in (("true", lambda i, j: True), ("src % 5 = dst % 5", lambda i, j: i % 5 == j % 5), ("false", lambda i, j: False)):
        got = [tuple(r) for r in simhash_dedup.checked_links(found, 15, 28, lambda d: d.where(check), Scratch(spark, "t")).collect()]
        want = {p for p in near if passes(*p)}
        assert set(got) <= want and roots(got) == roots(want)
        assert len(got) == len(set(got)) and (few < 90 or set(got) == want)
        assert simhash_dedup.checked_links(found.where("false"), 15, 28, lambda d: d.where(check), Scratch(spark, "t")).count() == 0
    assert 1 < len(set(roots(near))) < 90


def test_similar_texts_lie_within_the_radius():
    """Of texts whose five-word shingles have 0.8 to 0.83 in common, nine of ten and more."""
    rng, met, tried = random.Random(40), 0, 0
    while tried < 250:
        size = rng.choice([80, 150, 300, 600])
        one = words(rng, size).split()
        other = one[:]
        for i in rng.sample(range(size), round(size * 0.0215) or 1):
            other[i] = words(rng, 1) + "z"
        a, b = " ".join(one), " ".join(other)
        x, y = (set(simhash_dedup.shingles(t, 5).tolist()) for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.83:
            tried += 1
            one, two = (simhash_dedup._prints(t, 5, True) for t in (a, b))
            met += near_prints((one[0], two[0]), (one[1], two[1]), 0, 1)
    assert met >= 0.93 * tried


def test_simhash_tiles(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints = list(dict.fromkeys(prints + [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in prints[:80]] + [0, 1, 3, (1 << 64) - 1]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.link_fingerprints(distinct, 2, Scratch(spark, "t"), tile=3).collect()}
    want = grouped(prints, signed, 2)
    assert [roots.get(s, s) for s in signed] == want


def test_language_id(spark, empty):
    rng = random.Random(7)
    make = {"aa": lambda n: "".join(rng.choice("abcde ") for _ in range(n)), "bb": lambda n: "".join(rng.choice("vwxyz ") for _ in range(n))}
    rows = [(i, make[lang](300), lang if i % 9 else None) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (None, make["aa"](200), "aa"), (1003, make["aa"](5000), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.learning_sample(docs)
    assert sorted(samples) == ["aa", "bb"] and all(len(s) <= language_id.FIT_CHARS for s in samples.values())
    got = {r["doc_id"]: r for r in language_id.identify(docs, samples).collect()}
    assert all(got[i]["lang_pred"] == ["aa", "bb"][i % 2] for i in range(120)) and got[1003]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(empty, samples).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def parsed(text, sample):
    """Phrases of a greedy parse of the whole text: longest matches in the sample, or one symbol that it lacks."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


def test_cross_parse_counts_phrases(monkeypatch):
    rng = random.Random(8)
    samples = {k: "".join(rng.choice("abc") for _ in range(200)) for k in ("p", "q")} | {"r": "a" * 7 + "b"}
    parser = language_id.CrossParser(samples)
    texts = ["abcabcaab", "xaxbx", "a" * 5000, "z", "", "".join(rng.choice("abcd") for _ in range(5000)), "ab" * 1500, "a" * 511 + "b", "a" * 512, "".join(rng.choice("abc") for _ in range(5000))]
    want = [[parsed(t, samples[k]) for k in parser.languages] for t in texts]
    assert parser.phrases(texts)[0].tolist() == want
    monkeypatch.setattr(language_id, "_PASS", 2048)  # texts go on from one pass to the next
    assert parser.phrases(texts)[0].tolist() == want
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert parser.phrases(texts)[0].tolist() == want


def test_language_id_of_whole_tables(spark):
    """The query's rows from a plain parse of every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = {k: v.lower() for k, v in language_id.learning_sample(docs).items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = language_id.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        counts = sorted((parsed(text.lower(), samples[k]), k) for k in samples)
        assert (r["lang_pred"], r["score"]) == (counts[0][1], max(0.0, 1 - counts[0][0] / len(text.lower())))


def test_languages_of_a_dirty_column(spark):
    rows = [(i, f"text of row {i}", f"l{i % 40}" if i % 2 else "many") for i in range(400)]
    samples = language_id.learning_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_langs=3)
    assert len(samples) == 3 and "many" in samples


def test_language_id_tells_scripts_apart():
    rng = random.Random(15)
    latin, greek = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0xE0, 0xF7))) + "".join(map(chr, range(0x101, 0x180, 2))), "αβγδεζηθικλμνξοπρστυφχψω"
    cyrillic, kana = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x3041, 0x3097)))
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"el": make(greek, 800), "ja": make(kana, 800), "la": make(latin, 9000), "ru": make(cyrillic, 800)}
    parser = language_id.CrossParser(samples)
    assert [p for p, _ in parser.predict([make(x, 200) for x in (greek, kana, latin, cyrillic)])] == ["el", "ja", "la", "ru"]
    text = make(greek + kana[:20] + latin[:20] + cyrillic + "☃", 400)
    for k, count in zip(parser.languages, parser.phrases([text])[0][0]):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in samples[k]:
                j += 1
            n, i = n + 1, max(i + 1, j - 1)
        assert count == n


def test_mix(spark, empty):
    rows = [(i, "t", f"s{i % 3}" if i % 10 else None, 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, replica int")
    mixed = source_mix.mix_sources(docs, {"s0": 1.0, "s1": 3.0}, total_rows=6000, seed=1)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"s0", "s1"} and abs(counts["s0"] - 1500) < 200 and abs(counts["s1"] - 4500) < 350
    again = source_mix.mix_sources(docs.repartition(7), {"s0": 1.0, "s1": 3.0}, total_rows=6000, seed=1)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    keys = [r["shuffle_key"] for r in mixed.collect()]
    assert keys == sorted(keys) and mixed.select("doc_id", "replica").distinct().count() == len(keys)
    assert source_mix.mix_sources(docs, {}, 0.0).count() == 0
    assert source_mix.mix_sources(empty, {"a": 1.0}).count() == 0
    # Sources share the output evenly: two rows have no source, and six each of the others.
    large = source_mix.mix_sources(docs.limit(20), {}, 1.0, total_rows=20 * 300, seed=2).groupBy("doc_id").count().collect()
    want = {i: 1500 / (2 if i % 10 == 0 else 6) for i in range(20)}
    assert len(large) == 20 and all(abs(r["count"] - want[r["doc_id"]]) < 6 * want[r["doc_id"]] ** 0.5 for r in large)
    with pytest.raises(ValueError):
        source_mix.mix_sources(docs, {"a": -1.0})


def test_mix_at_high_rates(spark):
    # 21 sources of even weights; three of them have one or two rows: rates of 119 to 238, and of 571 to 1143 below.
    rows = [(i, "t", None, f"src{4 + i % 18}", 1) for i in range(5000)] + [(6000 + i, "t", None, [None, "a", "b", "b"][i], 1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    duck = duckdb.connect()
    documents = docs.toPandas()
    duck.register("documents", documents)
    counts = lambda mixed: {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").agg(F.count_distinct("replica").alias("count")).collect()}
    got = counts(source_mix.mix_sources(docs, source_mix.QUERY_WEIGHTS, source_mix.QUERY_DEFAULT, seed=source_mix.QUERY_SEED))
    assert got == dict(duck.execute(f"select doc_id, count(*) from ({source_mix.SQL}) group by doc_id").fetchall()) and got[6000] > 150
    got = counts(source_mix.mix_sources(docs, {}, 1.0, total_rows=24_000, seed=5).where("doc_id >= 6000"))
    # The rate of 1143 is split into pieces of copies.
    rates = {6000: 24_000 / 21, 6001: 24_000 / 21, 6002: 24_000 / 42, 6003: 24_000 / 42}
    for i, rate in rates.items():
        u, k, q = int(hashlib.md5(f"{i}:5".encode()).hexdigest()[:13], 16) / (1 << 52), 0, math.exp(-rate) if rate < 700 else 0.0
        while q <= u:
            k += 1
            q += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert got[i] == k


def test_mix_with_many_sources(docs, monkeypatch):
    want = sorted(map(str, source_mix.mix_sources(docs, {}, 1.0, total_rows=60, seed=3).collect()))
    monkeypatch.setattr(source_mix, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, source_mix.mix_sources(docs, {}, 1.0, total_rows=60, seed=3).collect())) == want and want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == distance(a, b)
        longer = max(len(a), len(b))
        assert line_dedup.similar(a, b, 0.7) == (distance(a, b) <= 0.3 * longer + 1e-9)


def meet(one, other):
    """Whether two normalised lines are compared: the rule of line_dedup, from their fingerprints alone."""
    tag = lambda b: b * line_dedup._MIX >> 16 & 65535
    for kind in set(one) & set(other):
        a, b = one[kind], other[kind]
        need = line_prints.NEED[kind]
        if sum(tag(x) == tag(y) for x, y in zip(a, b)) >= need and any(x == y != 0 for x, y in zip(a[: line_prints.BLOCKS + 1 - need], b)):
            return True
    return False


def prints_of(line):
    found = line_prints.lines_of(line)
    prints = {int(found.kind[0]): found.prints[0].tolist()}
    if len(found.more):
        prints[int(found.kind[0]) + 1] = found.more_prints[0].tolist()
    return prints


@pytest.mark.parametrize("run, tile, common", [(4096, 2048, 512), (3, 2, 1)])
def test_line_dedup(spark, docs, empty, monkeypatch, run, tile, common):
    for name, value in (("_RUN", run), ("_TILE", tile), ("_COMMON", common), ("_SAMPLE", 1)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(10)
    base, short, middle = words(rng, 80), words(rng, 5), words(rng, 14)
    near = [base.replace(base.split()[i], "changed", 1) for i in range(0, 40, 5)] + [f"{base} tail{c}" for c in "abcdefg"]
    near += [short + c for c in "abc"] + [middle.replace(middle.split()[i], "x", 1) for i in range(8)] + [words(rng, n) for n in (3, 9, 20, 28, 50)]
    rows = [(1000 - i, f"Head {i}!\n\n{t}\nHead  {i + 1}.\n{t}", "keep") for i, t in enumerate(near)]
    more = docs.select("doc_id", "text").withColumn("n_dropped", F.lit("x")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, n_dropped string"))
    unique = more.where("doc_id >= 900")  # whole ids that are unique and not null number the rows themselves
    for table in (more, unique) if run == 4096 else (unique,):
        data = [(r["doc_id"], r["text"], r["n_dropped"]) for r in table.collect()]
        data.sort(key=lambda r: (r[0] is None, r[0] or 0))
        lines = [(i, k, line_prints.normalise(x)) for i, (_, t, _) in enumerate(data) for k, x in enumerate((t or "").split("\n"))]
        distinct = list(dict.fromkeys(n for _, _, n in lines if n))
        prints = [prints_of(n) for n in distinct]
        parent = {n: n for n in distinct}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(distinct):
            for j in range(i):
                if find(a) != find(distinct[j]) and meet(prints[i], prints[j]) and line_dedup.similar(a, distinct[j], 0.8):
                    parent[find(a)] = find(distinct[j])
        seen, kept = set(), {}
        for i, k, n in lines:
            if not n or find(n) not in seen:
                kept.setdefault(i, []).append((data[i][1] or "").split("\n")[k])
            seen.add(find(n) if n else None)
        want = sorted(((d, None if t is None else "\n".join(kept.get(i, [])), len((t or "").split("\n")) - len(kept.get(i, []))) for i, (d, t, _) in enumerate(data)), key=str)
        got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(table).collect()), key=str)
        # Repeated texts of no id are in any order among themselves: what stays of them together is the same.
        assert [x for x in got if x[0] is not None] == [x for x in want if x[0] is not None] and sum(x[2] for x in got) == sum(x[2] for x in want)
        assert len({find(line_prints.normalise(t)) for t in near}) == 3 + 5
    if run == 4096:
        again = line_dedup.line_dedup(unique.repartition(5)).select("doc_id", "text").collect()
        assert sorted(map(tuple, again)) == sorted((d, t) for d, t, _ in got)
        assert line_dedup.line_dedup(empty).count() == 0


def test_lines_of_texts(monkeypatch):
    rng = random.Random(20)
    letters = "abcABC  \t\n\n.,-_0123456789éßİΣ😀日本_\xa0"
    for piece in (1 << 18, 40):  # the second cuts within texts and within lines
        monkeypatch.setattr(line_prints, "PIECE", piece)
        for _ in range(60):
            texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 200, 900]))) for _ in range(4)] + [None]
            got = {(r, p): k for rows, places, found in line_prints.lines_of_texts(range(5), texts) for r, p, k in zip(rows.tolist(), places.tolist(), found.key)}
            lines = {(r, i): line_prints.normalise(x) for r, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))}
            assert got == {place: xxhash.xxh3_128_digest(n.encode("utf-32-le")) for place, n in lines.items() if n}


@pytest.mark.parametrize("count, changed, least", [(10, 1, 0.99), (20, 2, 0.85), (40, 2, 0.99), (40, 4, 0.9), (80, 3, 0.99), (80, 5, 0.65), (200, 4, 0.9)])
def test_lines_with_changed_words_meet(count, changed, least):
    rng = random.Random(21)
    met = 0
    for _ in range(200):
        line = words(rng, count).split()
        other = line[:]
        for i in rng.sample(range(count), changed):
            other[i] = words(rng, 1) + "z"
        met += meet(prints_of(" ".join(line)), prints_of(" ".join(other)))
    assert met >= least * 200


def test_minimizers_meet():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, substring_dedup.K + substring_dedup.WINDOW - 1).astype(np.uint64)
    for _ in range(50):
        sides = [np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64), shared, rng.integers(0, 1 << 63, 30).astype(np.uint64)]) for _ in range(2)]
        assert len(set.intersection(*(set(substring_dedup.minimizers(s, np.array([len(s)]))[2].tolist()) for s in sides)))


def test_minimizers_of_many_texts():
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in [0, 3, 5, 6, 7, 8, 9, 30, 0, 60] for _ in range(3)] + [None, "\t a\n"]
    hashes, counts = hashed_texts(texts)
    assert counts.tolist() == [len((t or "").split()) for t in texts] and len(set(hashes.tolist())) == 3
    text, pos, mers = substring_dedup.minimizers(hashes, counts)
    nth = substring_dedup.occurrences(text, mers)
    got = list(zip(text.tolist(), pos.tolist(), mers.tolist(), nth.tolist()))
    want = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        value = {tuple(w[p : p + 5]): int(m) for j, p, m, _ in got if j == i}
        all_mers = _mers(w)
        width = min(substring_dedup.WINDOW, len(all_mers))
        chosen = sorted({min(range(s, s + width), key=lambda k: (all_mers[k], k)) for s in range(len(all_mers) - width + 1)}) if all_mers else []
        want += [(i, p, all_mers[p], sum(all_mers[q] == all_mers[p] for q in chosen if q < p)) for p in chosen]
        assert all(value[tuple(w[p : p + 5])] == all_mers[p] for p in chosen)
    assert got == want


def _mers(w):
    hashes = [int(hashed_texts([x])[0][0]) for x in w]
    found = []
    for i in range(len(w) - substring_dedup.K + 1):
        m = 0
        for h in hashes[i : i + substring_dedup.K]:
            m = (m * BASE + h) % (1 << 64)
        found.append(min(m ^ m >> 29, (1 << 64) - 2))
    return found


def test_chain_is_the_best():
    rng = random.Random(11)
    for _ in range(80):
        points = sorted({(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(rng.randint(1, 9))})
        x, y = [p[0] for p in points], [p[1] for p in points]
        best = [1.0] * len(x)
        for j in range(len(x)):
            for i in range(j):
                if x[i] < x[j] and y[i] < y[j]:
                    best[j] = max(best[j], best[i] + 1 - substring_dedup._GAP * (x[j] - x[i] + y[j] - y[i]))
        chains = substring_dedup.chain(x, y)
        first = chains[0]
        score = len(first) - substring_dedup._GAP * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert abs(score - max(best)) < 1e-9 and sorted(i for c in chains for i in c) == list(range(len(x)))
        assert all(x[a] < x[b] and y[a] < y[b] for c in chains for a, b in zip(c, c[1:]))


def test_substring_dedup(spark, empty):
    rng = random.Random(12)
    passage = words(rng, 80).split()
    fuzzy = passage[:]
    fuzzy[30] = fuzzy[60] = "changed"
    half = passage[:30]
    fresh = lambda n: words(rng, n)
    rows = [(1, f"{fresh(40)} {' '.join(passage)} {fresh(40)}"), (2, f"{' '.join(passage).upper()}"), (3, f"{fresh(10)} {' '.join(fuzzy)} {fresh(5)}"), (4, fresh(300)), (5, None), (6, ""), (None, f"{fresh(70)} {' '.join(passage)}"), (8, f"{' '.join(half)} {fresh(30)}"), (8, f"{' '.join(half)} {fresh(30)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert set(got) == {1, 2, 3, None}
    assert (got[1]["start_word"], got[1]["end_word"], got[1]["original"]) == (40, 120, True)
    assert (got[2]["start_word"], got[2]["end_word"], got[2]["original"]) == (0, 80, False)
    assert (got[3]["start_word"], got[3]["end_word"]) == (10, 90) and (got[None]["start_word"], got[None]["end_word"]) == (70, 150)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_of_whole_tables(spark):
    """The query's rows against all shared 50-word runs of the table, and every passage against the text of its partner."""
    docs = {r["doc_id"]: [w.lower() for w in WORD.findall(r["text"] or "")] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = substring_dedup.query(spark, "/root/testdata/sf0.001").collect()
    covered = {}
    for r in got:
        assert 50 <= r["n_words"] == r["end_word"] - r["start_word"] and 0 <= r["start_word"] and r["end_word"] <= len(docs[r["doc_id"]]) and r["partner_id"] != r["doc_id"]
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    where = {}
    for i, w in docs.items():
        for at in range(len(w) - 49):
            where.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    shared = [(i, at) for places in where.values() if len({i for i, _ in places}) > 1 for i, at in places]
    assert len(shared) > 500
    lost = {(i, at) for i, at in shared if not covered.get(i, set()).issuperset(range(at, at + 50))}
    assert not lost
    for r in got:
        passage = docs[r["doc_id"]][r["start_word"] : r["end_word"]]
        partner = docs[r["partner_id"]]
        runs = {tuple(partner[i : i + 5]) for i in range(len(partner) - 4)}
        assert any(tuple(passage[i : i + 5]) in runs for i in range(len(passage) - 4))
    first = {min(i for i, _ in places) for places in where.values() if len({i for i, _ in places}) > 1}
    assert all(i in covered for i in first)


def test_substring_dedup_finds_edited_passages(spark):
    rng = random.Random(14)
    rows, want = [], []
    for step in (7, 8, 9):  # every step-th word changed: no eight words in a row are equal where step is 8 or less
        passage = words(rng, 90).split()
        edited = [words(rng, 1) + "zz" if i % step == step - 1 else w for i, w in enumerate(passage)]
        rows += [(step, f"{words(rng, 30)} {' '.join(passage)} {words(rng, 30)}"), (step + 10, f"{words(rng, 20)} {' '.join(edited)} {words(rng, 20)}")]
        want += [step, step + 10]
    got = {r["doc_id"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == set(want)


def test_substring_dedup_does_not_depend_on_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SAMPLE", 1)
    rng = random.Random(16)
    rows = []
    for case in range(8):  # passages of 50 words, each line of which an earlier row has in another place
        lines = [words(rng, 10) for _ in range(5)]
        rows += [(100 * case + i, f"{words(rng, 15)} {x} {words(rng, 15)}") for i, x in enumerate(lines)]
        rows += [(100 * case + i, f"{words(rng, 20)} {' '.join(lines)} {words(rng, 20)}") for i in (50, 51)]
    same = words(rng, 70)
    rows += [(1000 + i, f"{words(rng, 5)} {same} {words(rng, 5)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for common in (20, 10**9):  # with the seeds of `same` dealt in parts, and in one
        monkeypatch.setattr(substring_dedup, "_COMMON", common)
        got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
        assert {i for i in got if i < 1000} == {100 * case + i for case in range(8) for i in (50, 51)}
        assert {i for i in got if i >= 1000} == set(range(1000, 1060))
        assert [i for i in sorted(got) if got[i]["original"] and i >= 1000] == [1000]


def test_sentence_pieces(spark, docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = sentence_pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(13)
    hard = ["▁", "a▁b", " ", "  two", "\n", "\x00", "😀" * 60, "a" * 300, "<s></s><0x0A>", " ▁ x▁▁y", "".join(rng.choice(" ▁ aetnoi\nüß😀日<0x>s") for _ in range(400))]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    rows = sorted(((r["doc_id"], r["text"]) for r in more.collect()), key=str)
    full = sentence_pieces.encode(more, path).collect()
    assert len(full) == len(rows)
    want = {(i, tuple(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in full} == want
    assert {(r["doc_id"], r["decoded"]) for r in full} == {(i, library.decode(list(ids))) for i, ids in want}
    text = {i: (t or "").encode() for i, t in rows}
    for r in full:
        assert r["ends"][-1] == len(text[r["doc_id"]]) and all(b <= e for b, e in zip(r["begins"], r["ends"]))
    short = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["span_bytes"]) for r in sentence_pieces.encode_digests(more, path).collect()}
    assert short == {(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(text[i])) for i, ids in want}
    assert sentence_pieces.encode_digests(empty, path).count() == 0


def test_piece_spans():
    model = PieceModel(open(sentence_pieces.default_model(), "rb").read())
    text = "  Hélló 日x"
    ids, begins, ends = model.encode(text)
    data = text.encode()
    pieces = [data[b:e].decode() for b, e in zip(begins, ends)]
    assert "".join(p for p, b, n in zip(pieces, begins, [*begins[1:], -1]) if b != n or not p) in (text, "".join(pieces))


def double_array(entries):
    """A double-array trie of byte strings, laid out by search, and its replacements, as the file format has them."""
    values, blob = {}, b""
    for key, text in entries.items():
        values[key], blob = len(blob), blob + text + b"\0"
    units, taken = {0: 0}, {0}

    def place(prefix, node):
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        offset = 1
        while any((node ^ offset ^ c) in taken for c in labels + ([0] if leaf else [])) or (node ^ offset) == 0:
            offset += 1
        units[node] = units.get(node, 0) | offset << 10 | (1 << 8 if leaf else 0)
        base = node ^ offset
        taken.update(base ^ c for c in labels)
        if leaf:
            taken.add(base)
            units[base] = values[prefix] | 1 << 31
        for c in labels:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    array = np.array([units.get(i, 0) for i in range(max(units) + 257)], "<u4").tobytes()
    return len(array).to_bytes(4, "little") + array + blob


def test_character_map_takes_the_longest_prefix():
    entries = {b"a": b"1", b"ab": b"22", b"abcd": b"", "é".encode(): b"e", b"x": b" "}
    table = CharacterMap(double_array(entries))
    for text in (b"abz", b"abcd", b"abc", b"zz", "é!".encode(), b"x", b"a"):
        best = max((k for k in entries if text.startswith(k)), key=len, default=None)
        assert table.longest(text, 0) == (None if best is None else (len(best), entries[best]))


def test_lines_are_rows_once(spark):
    """A line is one row, with both of its fingerprints, and only lines that are similar to another are grouped."""
    rng = random.Random(3)
    lines = [next(x for x in iter(lambda: words(rng, 4), None) if len(x) < 20), next(x for x in iter(lambda: words(rng, 9), None) if 39 <= len(x) < 48)]
    table = line_dedup.line_table(spark.createDataFrame([(7, "\n".join(lines + lines[:1]))], "row long, text string")).orderBy("line").collect()
    assert [(r["line"], r["again"], r["q0"] is None) for r in table] == [(0, False, True), (1, False, False), (2, True, True)]
    for r, line in zip(table, lines):
        found = line_prints.lines_of(line)
        unsigned = lambda names: [r[n] >> half & 0xFFFFFFFF for n in names for half in (0, 32)]
        assert unsigned(line_dedup._P) == found.prints[0].tolist() and (r["q0"] is None or unsigned(line_dedup._Q) == found.more_prints[0].tolist())
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(2))
        assert line_dedup._surplus(a, b) <= line_dedup.edit_distance(a, b)
