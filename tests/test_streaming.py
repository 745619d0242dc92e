"""Streams: repeats and late rows over several batches and runs, against a plain count."""

import json
from collections import Counter

import pytest

from prismlake.sources.keyed_table import read_keyed
from prismlake.streaming.ingest import stream_bucket_counts, stream_ingest

SCHEMA = "UUID_STRING string, DATA_TYPE string, TIMESTAMP_UTC string, n int"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("UUID_STRING", "DATA_TYPE", "TIMESTAMP_UTC", "n"), r))) for r in rows))


def counts(spark, path):
    return {(str(r.BUCKETED_TIMESTAMP_HOUR), r.DATA_TYPE): r.COUNT for r in read_keyed(spark, path).collect()}


def test_counts_carry_over_batches_and_runs(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    source, target, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    at = lambda k: f"2024-01-01T{k // 60:02}:{k % 60:02}:00Z"
    rows = [(f"u{k}", ["PHOTO", "VIDEO", None][k % 3], at(k), k) for k in range(300)]
    run = lambda: stream_bucket_counts(spark, str(source), schema, target, state, late_by="2 hours", files_per_batch=1).awaitTermination()
    want = lambda some: Counter((f"2024-01-01 {k // 60:02}:00:00", kind or "Unknown") for kind, k in {(r[1], r[3]) for r in some})

    write(source, "a.json", rows[:150])
    write(source, "b.json", rows[100:200] + rows[190:200] + [("none", "PHOTO", None, 1), (None, "PHOTO", at(5), 5)])  # repeats within and over files
    run()
    assert counts(spark, target) == want(rows[:200])
    write(source, "c.json", rows[150:250] + rows[:40])  # the newest time is 03:19: of these the first 40 are more than 2 hours late
    run()
    assert counts(spark, target) == want(rows[:250])
    write(source, "d.json", rows[250:])
    write(source, "e.json", [("late but in time", "PHOTO", at(230), 0), ("too late", "PHOTO", at(3), 0)])
    run()
    got = counts(spark, target)
    expected = want(rows)
    expected["2024-01-01 03:00:00", "PHOTO"] += 1
    assert got == expected
    run()  # nothing new
    assert counts(spark, target) == expected
    with pytest.raises(ValueError, match="a day or shorter"):
        stream_bucket_counts(spark, str(source), schema, target, state, level="MONTH")


def test_replayed_and_repeated_rows_over_batches(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    source, target = tmp_path / "in", str(tmp_path / "t")
    rows = [(f"u{k}", "PHOTO", "2024-01-01T10:00:00Z", k) for k in range(20)]
    write(source, "a.json", rows + rows[:5])
    stream_ingest(spark, str(source), schema, target, str(tmp_path / "c1")).awaitTermination()
    write(source, "b.json", [(u, d, t, n + 100) for u, d, t, n in rows[15:]] + [("u99", "VIDEO", "2024-01-02T10:00:00Z", 99)])
    stream_ingest(spark, str(source), schema, target, str(tmp_path / "c1")).awaitTermination()
    want = {f"u{k}": k if k < 15 else k + 100 for k in range(20)} | {"u99": 99}
    assert {r.UUID_STRING: r.n for r in read_keyed(spark, target).collect()} == want
    # all files once more, under a new checkpoint, change nothing but what their order decides
    stream_ingest(spark, str(source), schema, target, str(tmp_path / "c2")).awaitTermination()
    assert {r.UUID_STRING for r in read_keyed(spark, target).collect()} == set(want)
