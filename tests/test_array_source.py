"""Array files: round trips in both orders, splits, filters, broken files, writes that leave nothing behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegraph.sources.arrays import ArrayReader, blocks, read_arrays, write_arrays


def matrix(df, member=None):
    """Arrays by file, from rows that may come in any order."""
    found = {}
    for r in df.collect():
        found.setdefault((os.path.basename(r.path), r.member), []).append((r.row, r.shape, r["values"]))
    out = {}
    for key, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        out[key] = np.array([r[2] for r in rows]).reshape(len(rows), *rows[0][1])
    return out


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i4", "|u1", "|b1", "<f2"])
def test_splits_are_the_array(tmp_path, order, kind):
    for shape in [(37, 3, 4), (11,), (5, 1), (4, 0), (0, 3), ()]:
        array = np.asarray(np.arange(np.prod(shape, dtype=int)).reshape(shape) % 100, dtype=kind, order=order)
        np.save(tmp_path / "a.npy", array)
        for parts in (1, 2, 5):
            rows = []
            for part in range(parts):
                with open(tmp_path / "a.npy", "rb") as file:
                    for first, rest, found in blocks(file, part, parts, most=64):
                        assert rest == shape[1:] and first == len(rows)
                        rows += list(found)
            assert np.array_equal(np.array(rows).reshape(shape) if rows else array, array)


def test_files_and_members(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(300, 8)), np.asfortranarray(rng.normal(size=(40, 2, 3))), rng.integers(0, 9, size=50)
    np.save(tmp_path / "a.npy", a)
    os.mkdir(tmp_path / "deep")
    np.savez(tmp_path / "deep" / "z.npz", b=b, c=c)
    np.savez_compressed(tmp_path / "y.npz", b=b)
    for most in (1 << 20, 1000):  # whole files, and files in parts
        df = read_arrays(spark, str(tmp_path), maxPartitionBytes=most)
        got = matrix(df)
        want = {("a.npy", None): a, ("z.npz", "b"): b, ("z.npz", "c"): c, ("y.npz", "b"): b}
        assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    assert df.rdd.getNumPartitions() > 20
    assert set(matrix(df.where("member = 'b'"))) == {("z.npz", "b"), ("y.npz", "b")}
    assert df.where("member is null").count() == 300 and df.where("member = 'none'").count() == 0
    assert matrix(read_arrays(spark, str(tmp_path / "a.npy"))).keys() == {("a.npy", None)}


def test_filter_on_member_is_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = ArrayReader({"path": "/none"})
    assert list(reader.pushFilters([EqualTo(("member",), "b"), GreaterThan(("row",), 3)])) == [GreaterThan(("row",), 3)] and reader.members == {"b"}


def test_whole_numbers(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2**60 + 1]]))
    assert read_arrays(spark, str(tmp_path), "long").head()["values"] == [1, 2**60 + 1]
    with pytest.raises(Exception, match="beyond 2"):
        read_arrays(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("array", [np.array(["text"]), np.array([{}], dtype=object), np.array([1j])])
def test_other_kinds_are_errors(spark, tmp_path, array):
    np.save(tmp_path / "a.npy", array)
    with pytest.raises(Exception, match="a.npy"):
        read_arrays(spark, str(tmp_path)).collect()


def test_a_file_that_breaks_off(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(100.0))
    with open(tmp_path / "a.npy", "r+b") as file:
        file.truncate(300)
    with pytest.raises(Exception, match="ends inside"):
        read_arrays(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("dtype", "order"), [("float64", "C"), ("float32", "F"), ("int64", "F")])
def test_round_trip(spark, tmp_path, dtype, order):
    df = spark.range(5000).select("id", F.array("id", F.col("id") * 2, F.col("id") % 7).alias("v"))
    write_arrays(df, str(tmp_path / "out"), "v", "id", dtype=dtype, order=order, blockBytes=4096)
    names = sorted(os.listdir(tmp_path / "out"))
    files = [np.load(tmp_path / "out" / n) for n in names]
    assert all(f.dtype == dtype and f.nbytes <= 4096 for f in files) and len(files) > 5
    assert np.array_equal(np.concatenate(files)[:, 0], np.arange(5000))
    back = read_arrays(spark, str(tmp_path / "out"), "long" if dtype == "int64" else "double")
    assert sorted(map(tuple, (r["values"] for r in back.collect()))) == [(i, 2 * i, i % 7) for i in range(5000)]
    write_arrays(df.limit(3), str(tmp_path / "out"), "v", "id", mode="overwrite", dtype=dtype)
    assert read_arrays(spark, str(tmp_path / "out"), "long" if dtype == "int64" else "double").count() == 3


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(100)
    write_arrays(df.select("id", F.array("id").alias("v")), out, "v", "id", dtype="int64")
    before = sorted(os.listdir(out))
    with pytest.raises(Exception, match="null"):
        write_arrays(df.select("id", F.array(F.when(F.col("id") != 70, F.col("id"))).alias("v")), out, "v", "id", dtype="int64")
    assert sorted(os.listdir(out)) == before
    ragged = df.select("id", F.array_repeat("id", (F.col("id") % 3).cast("int")).alias("v"))
    write_arrays(ragged, out, "v", "id", mode="overwrite", dtype="int64")
    assert read_arrays(spark, out, "long").selectExpr("sum(size(values))").head()[0] == 99
