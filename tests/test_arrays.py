"""Array files as numpy writes them, damaged ones, and tables databases page by page."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays


def npy(array, **how):
    out = io.BytesIO()
    np.save(out, array, **how)
    return out.getvalue()


def npz(compressed=False, **named):
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **named)
    return out.getvalue()


@pytest.mark.parametrize("kind", ["<f8", ">f8", "<f4", "<f2", "<i8", "|u1", "|b1"])
def test_npy(kind):
    rng = np.random.default_rng(1)
    for shape in ((5,), (3, 4), (0,), (0, 3), (2, 0)):
        x = (rng.random(shape) * 100).astype(kind)
        assert np.array_equal(arrays.npy_array(npy(x)), x) and np.array_equal(arrays.npy_array(npy(np.asfortranarray(x))), x)
    big = np.zeros(3, np.dtype([("a" * 70000, "<f4")]))  # a header of the second version
    with pytest.raises(ValueError, match="type"):
        arrays.npy_array(npy(big))


def test_damaged_arrays():
    good = npy(np.arange(6.0).reshape(2, 3))
    for cut in range(len(good)):
        with pytest.raises(ValueError):
            arrays.npy_array(good[:cut])
    for wrong in (good + b"x", npy(np.array([{}], dtype=object)), npy(np.array(1.0)), npy(np.zeros((1, 1, 1))), npy(np.array(["a"])), npy(np.array([1j]))):
        with pytest.raises(ValueError):
            arrays.npy_array(wrong)
    for old, new in ((b"(2, 3)", b"(9, 9)"), (b"(2, 3)", b"(-2,3)"), (b"(2, 3)", b"(2.,3)"), (b"'<f8'", b"'<q9'"), (b"False", b"Falsy"), (b"'descr'", b"'other'"), (b"(2, 3)", b"(" * 6), (b"(2, 3)", b"(9**9)")):
        with pytest.raises(ValueError):
            arrays.npy_array(good.replace(old, new))
    rng = random.Random(3)
    archive = npz(compressed=True, a=np.arange(50.0), b=np.arange(9.0))
    for _ in range(300):
        hurt = bytearray(archive)
        for _ in range(3):
            hurt[rng.randrange(len(hurt))] = rng.randrange(256)
        try:
            list(arrays.npz_arrays(bytes(hurt)))
        except ValueError:
            pass
    for wrong in (archive[: len(archive) // 2], b"", b"PK\x03\x04"):
        with pytest.raises(ValueError):
            list(arrays.npz_arrays(wrong))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    with pytest.raises(ValueError, match="no array"):
        list(arrays.npz_arrays(out.getvalue()))


def test_coordinates_and_spaces(spark, tmp_path):
    rng = np.random.default_rng(2)
    one, many = rng.normal(size=6), rng.normal(size=(700, 6)).astype(np.float32)
    space = {f"layer_{layer}__{c}": rng.normal(size=4) for layer in (3, 12) for c in ("happy", "very_sad")}
    for name, data in (("one.npy", npy(one)), ("many.v2.npy", npy(many)), ("space.npz", npz(**space)), ("flat.npz", npz(True, happy=one, sad=-one))):
        (tmp_path / name).write_bytes(data)
    found = arrays.read_arrays(spark, str(tmp_path / "*.npy"))
    assert found.count() == 701
    got = {(r["coordinate"], r["layer"]): r for r in arrays.coordinates(found).collect()}
    assert len(got) == 701 and got["one", 0]["raw_vector"] == one.tolist() and got["one", 0]["norm"] == pytest.approx(np.linalg.norm(one))
    assert np.allclose(got["many.v2", 699]["vector"], many[699] / np.linalg.norm(many[699].astype(float)))
    picked = arrays.coordinates(found, "axis", 5).collect()
    assert sorted(map(str, (r["raw_vector"] for r in picked))) == sorted(map(str, (one.tolist(), many[5].astype(float).tolist()))) and {r["layer"] for r in picked} == {5}
    read = arrays.vector_space(arrays.read_arrays(spark, str(tmp_path / "space.npz"))).collect()
    assert {(r["layer"], r["concept"]): r["vector"] for r in read} == {(int(k[6:].split("__")[0]), k.split("__", 1)[1]): v.tolist() for k, v in space.items()}
    flat = arrays.read_arrays(spark, str(tmp_path / "flat.npz"))
    assert {(r["layer"], r["concept"]) for r in arrays.vector_space(flat, 7).collect()} == {(7, "happy"), (7, "sad")}
    with pytest.raises(Exception, match="no vector with a layer"):
        arrays.vector_space(flat).collect()
    (tmp_path / "hurt.npy").write_bytes(npy(one)[:-3])
    with pytest.raises(Exception, match="hurt.npy"):
        arrays.read_arrays(spark, str(tmp_path / "hurt.npy")).collect()


def test_written_vectors_are_npy_files(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0, 1e300]), (2, []), (3, None)], "i int, v array<double>")
    got = {r["i"]: r["b"] for r in rows.select("i", arrays.npy_bytes(F.col("v")).alias("b")).collect()}
    assert got[3] is None and [np.load(io.BytesIO(got[i])).tolist() for i in (1, 2)] == [[1.5, -2.0, 1e300], []]
