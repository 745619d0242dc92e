"""Arrays in JSON files of many splits, against the json module."""

import json

import numpy as np
import pytest

from prismlake.sources import json_array
from prismlake.sources.json_array import json_array_entries
from prismlake.sources.readers import read_takeout


def entry(rng, k):
    """A location with nested and awkward parts."""
    made = {"timestamp": f"2021-03-{1 + k % 28:02}T00:00:{k % 60:02}Z", "latitudeE7": int(rng.integers(-900000000, 900000000)), "longitudeE7": int(rng.integers(-1800000000, 1800000000)), "n": k}
    if rng.random() < 0.3:
        made["activity"] = [{"type": "WALK", "of": [{}, {"}": "{"}]}, []]
    if rng.random() < 0.3:
        made["note"] = rng.choice(['a "quoted" } brace', "back\\slash\\", '\\"', "]}", "{[", "é漢😀", "\\\\\\", 'x"}]},{"'])
    return made


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    rng = np.random.default_rng(4)
    root = tmp_path_factory.mktemp("json")
    wanted = {}

    def write(name, value, **how):
        (root / name).mkdir()
        text = value if isinstance(value, str) else json.dumps(value, **how)
        (root / name / "Records.json").write_text(text, encoding="utf-8")
        try:
            parsed = json.loads(text)
            ok = isinstance(parsed, dict) and isinstance(parsed.get("locations"), list)
        except ValueError:
            ok = False
        wanted[name] = [e for e in parsed["locations"] if isinstance(e, dict)] if ok else None

    many = [entry(rng, k) for k in range(160)]
    write("plain", {"locations": many})
    write("spaced", {"locations": many[:30]}, indent=3)
    write("raw", {"locations": many[:40]}, ensure_ascii=False)
    write("line_end", json.dumps({"locations": many[:50]}) + "\n \n")
    write("mixed", {"before": {"a": {"x": 1}, "b": [{"y": 2}]}, "list": [{"locations": [{"z": 3}]}, 4], "locations": ["text", *many[:60], 5, None, [{"in": "list"}], many[60]], "after": [{"q": 1}] * 20, "last": {"locations": [{"w": 1}]}})
    write("one_huge", {"locations": [many[0], {"n": -1, "long": [{"k": "v}\\\""}] * 300}, many[1]]})
    write("empty_list", {"locations": []})
    write("only_scalars", {"locations": [1, "}", []]})
    write("no_list", {"locations": {"a": {"b": 1}}})
    write("other_key", {"places": many[:5]})
    write("bad_entry", json.dumps({"locations": many[:30]}).replace('"n": 7', '"n": 07x'))
    write("bad_gap", json.dumps({"locations": many[:30]}).replace("}, {", "} {", 1))
    write("cut_short", json.dumps({"locations": many[:30]})[:-40])
    write("cut_at_entry", json.dumps({"locations": many[:30]})[:-2])
    write("words", "not json")
    write("broken", "{broken")
    write("array", json.dumps([{"locations": many[:3]}]))
    return str(root), wanted


@pytest.mark.parametrize("split_bytes, scan_bytes", [(1_000, 100), (1 << 27, 2000)])
def test_entries_of_files_in_splits(spark, written, monkeypatch, split_bytes, scan_bytes):
    monkeypatch.setattr(json_array, "SCAN_BYTES", scan_bytes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        entries, bad = json_array_entries(spark, written[0], "Records.json", "locations")
        found = {}
        for r in entries.collect():
            found.setdefault(r.file.split("/")[-2], []).append(json.dumps(json.loads(r.entry), sort_keys=True))
        quarantined = {r.file.split("/")[-2] for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert quarantined == {name for name, entries in written[1].items() if entries is None}
    assert {k: sorted(v) for k, v in found.items()} == {name: sorted(json.dumps(e, sort_keys=True) for e in entries) for name, entries in written[1].items() if entries}


def test_a_large_export_in_several_tasks(spark, tmp_path):
    """The array once grew beyond what one value may hold; here it is cut into many splits."""
    (tmp_path / "Records.json").write_text('{"locations": [' + ",\n".join(f'{{"timestamp": "2021-03-01T00:{k // 60 % 60:02}:{k % 60:02}Z", "latitudeE7": {k * 1000}, "longitudeE7": {-k * 1000}, "activity": [{{"t": "}}"}}]}}' for k in range(10_000)) + "]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        points, bad = read_takeout(spark, str(tmp_path))
        got = {(r.GPS_LATITUDE, r.GPS_LONGITUDE) for r in points.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(k * 1000 / 1e7, -k * 1000 / 1e7) for k in range(10_000)} and bad.count() == 0
