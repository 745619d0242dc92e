"""Keyed tables: what a batch touches, null keys, new columns, and failures between the steps."""

import glob
import os

import pytest

from prismlake.sources import keyed_table as K
from prismlake.sources.sinks import merged


def contents(spark, path):
    return sorted(map(repr, (r.asDict() for r in K.read_keyed(spark, path).collect())))


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{K.BUCKET}=*/*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).selectExpr("id as k", "id * 2 as v")
    assert K.upsert(rows, path, "k", buckets=128) == 128
    before = files_of(path)
    batch = spark.createDataFrame([(17, -1, "new"), (90_000, -2, "new")], "k long, v long, note string")
    assert K.upsert(batch, path, "k") == 2
    after = files_of(path)
    assert len(set(before) - set(after)) == 2 and all(after[f] == before[f] for f in set(before) & set(after))
    got = {r.k: (r.v, r.note) for r in K.read_keyed(spark, path).collect()}
    assert got == {k: (2 * k, None) for k in range(4000)} | {17: (-1, "new"), 90_000: (-2, "new")}
    assert K.upsert(batch.limit(0), path, "k") == 0
    with pytest.raises(ValueError, match="key is k"):
        K.upsert(batch, path, "v")


def test_null_keys_stay_and_are_replaced(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    new = spark.createDataFrame([(None, "c"), (2, "d")], "k int, x string")
    want = [(1, "a"), (2, "d"), (None, "c")]
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, merged(old, new, "k").collect()), key=key) == want
    assert sorted(map(tuple, merged(None, new, "k").collect()), key=key) == want[1:]
    assert sorted(map(tuple, merged(old, new, "k", mode="patch").collect()), key=key) == want
    K.upsert(old, str(tmp_path / "t"), "k")
    K.upsert(new, str(tmp_path / "t"), "k")
    assert sorted(map(tuple, K.read_keyed(spark, str(tmp_path / "t")).collect()), key=key) == want


def test_columns_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "t")
    K.upsert(spark.createDataFrame([(1, 5)], "k long, n int"), path, "k")
    K.upsert(spark.createDataFrame([(2, 6, [1.5])], "k int, n long, v array<double>"), path, "k", mode="patch")
    K.upsert(spark.createDataFrame([(2, [2.5])], "k int, v array<double>"), path, "k", mode="patch")
    assert contents(spark, path) == sorted(map(repr, [{"k": 1, "n": 5, "v": None}, {"k": 2, "n": 6, "v": [2.5]}]))
    with pytest.raises(Exception, match="CAST|overflow"):
        K.upsert(spark.createDataFrame([(3, 1 << 40)], "k long, n long"), path, "k")
    assert K.read_keyed(spark, path).count() == 2 and not os.path.exists(f"{path}/{K.WRITER}")


def test_a_plain_table_is_laid_out_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string").write.parquet(path)
    assert K.read_keyed(spark, path).count() == 2
    K.upsert(spark.createDataFrame([(2, "c")], "k int, x string"), path, "k", buckets=4)
    assert sorted(map(tuple, K.read_keyed(spark, path).collect())) == [(1, "a"), (2, "c")]
    assert not glob.glob(f"{path}/*.parquet") and K.layout_of(spark, path) == {"key": "k", "buckets": 4}


@pytest.mark.parametrize("dies_at", ["staging", "layout", "mark", "first move", "second move", "clearing"])
@pytest.mark.parametrize("first", [True, False])
def test_a_failure_leaves_the_old_table_or_the_new(spark, tmp_path, monkeypatch, dies_at, first):
    path = str(tmp_path / "t")
    old, new = (spark.createDataFrame([(k, x) for k in ks], "k int, x string") for ks, x in ((range(40), "old"), (range(20, 60), "new")))
    if not first:
        K.upsert(old, path, "k", buckets=4)
    before = contents(spark, path) if not first else None
    calls = {"n": 0}
    real_write, real_move, real_delete, real_unique = K._Files.write, K._Files.move, K._Files.delete, K.assert_unique_key

    def write(self, text, *parts):
        if (dies_at, parts[-1]) in (("layout", K.LAYOUT), ("mark", K.READY)):
            raise OSError("died")
        real_write(self, text, *parts)

    def move(self, source, target):
        calls["n"] += 1
        if (dies_at, calls["n"]) in (("first move", 1), ("second move", 2)):
            raise OSError("died")
        real_move(self, source, target)

    def delete(self, *parts):
        if dies_at == "clearing" and parts == (K.STAGED,):
            raise OSError("died")
        real_delete(self, *parts)

    def unique(df, key):
        if dies_at == "staging" and K.BUCKET in df.columns:
            raise OSError("died")
        return real_unique(df, key)

    for name, f in (("write", write), ("move", move), ("delete", delete)):
        monkeypatch.setattr(K._Files, name, f)
    monkeypatch.setattr(K, "assert_unique_key", unique)
    if dies_at == "layout" and not first:
        K.upsert(new, path, "k", buckets=4)  # a table's layout is written once
    else:
        with pytest.raises(OSError, match="died"):
            K.upsert(new, path, "k", buckets=4)
    monkeypatch.undo()
    K.recover(spark, path)
    done = dies_at in ("first move", "second move", "clearing") or (dies_at == "layout" and not first)
    if done:
        assert contents(spark, path) == contents_of_both(spark, old if not first else None, new)
    elif first:
        assert not glob.glob(f"{path}/{K.BUCKET}=*")
    else:
        assert contents(spark, path) == before
    K.upsert(new, path, "k", buckets=4)
    assert contents(spark, path) == contents_of_both(spark, old if not first else None, new)


def contents_of_both(spark, old, new):
    rows = {r.k: r.asDict() for df in (old, new) if df is not None for r in df.collect()}
    return sorted(map(repr, rows.values()))


def test_one_writer_at_a_time(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame([(1,)], "k int")
    with K._only_writer(K._Files(spark, path)), pytest.raises(RuntimeError, match="has a writer"):
        K.upsert(row, path, "k")
    assert K.upsert(row, path, "k", buckets=2) == 1
