"""The JSON item reader against whole documents, damaged ones, and one much larger than its memory."""

import gzip
import io
import json
import random
import tracemalloc

import pytest

from tessera.sources import json_items


def value(rng, depth=3):
    kind = rng.randrange(8 if depth else 6)
    if kind == 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return {rng.choice(["rows", "a", "é\"", "b\\"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(-(10**9), 10**9), rng.random() * 1e-7, rng.choice(["", "]", '}"[', "\\", "😀é\n", '\\"']), "x" * rng.randrange(60)][kind]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_items_of_any_document(chunk):
    rng = random.Random(chunk)
    for case in range(40):
        rows = [value(rng) for _ in range(rng.randrange(6))]
        whole = {"first": value(rng), "data": {"x": value(rng), "rows": rows, "y": value(rng)}, "z": 1}
        text = json.dumps(whole, ensure_ascii=case % 2 == 0, indent=[None, 2][case % 3 == 0]).encode()
        assert [json.loads(t) for t in json_items.items(io.BytesIO(text), "data.rows", chunk)] == rows
        assert [json.loads(t) for t in json_items.items(io.BytesIO(b"\xef\xbb\xbf \n" + json.dumps(rows).encode()), "", chunk)] == rows


@pytest.mark.parametrize("text", ['{"rows": [1, 2', '{"rows": [1 2]}', '{"rows": {"a": 1}}', '{"other": [1]}', "", '{"rows"', '{"a": "x', '{"a": [1, 2, "rows": [1]', '{"rows": [1,]}', '{"rows": [tru]}', "[1, 2]"])
def test_damaged_documents(text):
    with pytest.raises(ValueError):
        list(json_items.items(io.BytesIO(text.encode()), "rows", 3))


class Endless(io.RawIOBase):
    """A document with a list of about `size` bytes before the rows, and rows of as many, made as it is read."""

    def __init__(self, size):
        item = json.dumps({"key": 1, "text": "some text of a row, \\ \" " * 20})
        n = size // len(item)
        self.parts = iter(['{"skipped": [0', *(("," + item) for _ in range(n)), '], "rows": [1', *(("," + item) for _ in range(n)), "]}"])
        self.n, self.left = n + 1, b""

    def read(self, size=-1):
        while len(self.left) < size and (part := next(self.parts, None)) is not None:
            self.left += part.encode()
        found, self.left = self.left[:size], self.left[size:]
        return found


def test_memory_does_not_grow_with_the_document():
    file = Endless(60 << 20)
    tracemalloc.start()
    count = sum(1 for _ in json_items.items(file, "rows", 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == file.n and peak < 4 << 20


def test_data_source(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"id": i, "text": "".join(rng.choice('ab"\\é\n') for _ in range(rng.randrange(40))), "score": rng.random() if i % 3 else None, "tags": ["a"] * (i % 4)} for i in range(2500)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"meta": {"n": 1}, "rows": rows[:1500]}))
    (folder / "b.json.gz").write_bytes(gzip.compress(json.dumps({"rows": rows[1500:]}, indent=1).encode()))
    (folder / "_done").write_text("no JSON")
    schema = "id long, text string, score double, tags array<string>"
    got = json_items.read_items(spark, str(folder), "rows", schema)
    assert got.rdd.getNumPartitions() == 2
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps(rows))
    want = spark.read.schema(schema).option("multiLine", True).json(str(plain))
    assert sorted(map(str, got.select("id", "text", "score", "tags").collect())) == sorted(map(str, want.collect()))
    places = [r["place"] for r in got.where("file like '%a.json'").orderBy("id").collect()]
    assert places == list(range(1500))
    assert json_items.read_items(spark, f"file://{folder}/a.json").count() == 1500
    with pytest.raises(Exception):
        json_items.read_items(spark, str(tmp_path / "nothing")).count()
