"""One large array in a JSON object, read in byte ranges by many tasks.

Spark's text reader cuts a file at closing braces, in splits of any size, on any store it can read.
Whether a split starts inside a string, and how deep, follows from what lies before it: a first pass
measures each split for both cases, a running sum over the splits of a file settles which holds, and
a second pass cuts the entries of the array at their own braces. Entries that reach over the end of
a split are put together from its neighbours.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Bytes of a split that are scanned at a time.
SCAN_BYTES = 1 << 20
_SIGN = np.zeros(256, np.int8)
_SIGN[[ord("{"), ord("[")]], _SIGN[[ord("}"), ord("]")]] = 1, -1
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.S)
_CUT = "file string, block long, seq long, key string, entry binary, sound boolean, skeleton binary, piece binary, closes boolean, depth int"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.bool_(), pa.int32()]
#: Places of an entry that reaches over its split's end, and of the file's end, after all others of the split.
OVER, END = 1 << 40, 1 << 41


def _brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and signs of all brackets, whether an odd number of quotes lies before each, and the quotes' parity.

    ``data`` starts at no escape: it follows a closing brace, or is the start of a file.
    """
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    if b"\\" in data:
        slashes = np.flatnonzero(a == 92)
        starts = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        lengths = np.diff(np.r_[starts, len(slashes)])
        quotes = np.setdiff1d(quotes, (slashes[starts] + lengths)[lengths % 2 == 1], assume_unique=True)
    at = np.flatnonzero(_SIGN[a])
    return at, _SIGN[a[at]].astype(np.int64), np.searchsorted(quotes, at) & 1, len(quotes) & 1


def _sound_gap(gap: bytes) -> bool:
    """Whether what lies between two objects is a comma, or a comma and other values."""
    if gap.strip() == b",":
        return True
    for opened, closed in ((b"[0", b"0]"), (b'{"":0', b"0}")):
        try:
            json.loads(opened + gap + closed)
            return True
        except ValueError:
            pass
    return False


def _units(data: bytes, depth: int) -> tuple[list[tuple], int]:
    """Objects at depth 3, that is the entries of containers in the outermost object: (key or None, entry, sound, skeleton or None), and where the last ends.

    ``key`` is given where the container is opened before the entry, "" if it is no array; the text
    before such an entry goes to the file's skeleton, with a 0 for the entry.
    """
    at, sign, odd, _ = _brackets(data)
    outside = odd == 0
    at, sign = at[outside], sign[outside]
    depths = depth + np.cumsum(sign)
    opens, closes = at[(sign > 0) & (depths == 3)], at[(sign < 0) & (depths == 2)]
    low, containers = at[depths < 2], at[(sign > 0) & (depths == 2)]
    found, end = [], 0
    opens_of = np.searchsorted(opens, closes) - 1
    for n, close in zip(opens_of.tolist(), closes.tolist()):
        if n < 0 or data[close] != 125 or data[opens[n]] != 123:
            continue  # an array is no entry; it stays in the gap
        start = int(opens[n])
        gap, entry = data[end:start], data[start : close + 1]
        if (depth < 2 and not found) or np.searchsorted(low, start) > np.searchsorted(low, end):
            k = np.searchsorted(containers, start) - 1
            key = ""
            if k >= 0 and data[containers[k]] == 91:
                named = _KEY.search(data[end : containers[k]])
                try:
                    key = json.loads(named[1]) if named else ""
                except ValueError:
                    pass
            found.append((key, entry, True, gap + b"0"))
        else:
            found.append((None, entry, _sound_gap(gap), None))
        end = close + 1
    return found, end


def _cut_rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), _KINDS)], names=[f.split()[0] for f in _CUT.split(", ")])


def _same_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Rows of one split at a time, in order: its columns but ``part``, and the parts."""
    for batch in batches:
        n = batch.num_rows
        parts = batch.column("part").to_pylist()
        new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (batch.column("file"), batch.column("block"))]
        cuts = [0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield {name: batch.column(name)[a].as_py() for name in batch.schema.names if name != "part"}, parts[a:b]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: bytes, parity of quotes, and change of depth if it starts outside or inside a string."""
    now, sums = None, np.zeros(4, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "block": pa.array([now[1]], pa.int64()), "size": pa.array([now[2]], pa.int64()), **{n: pa.array([v], pa.int64()) for n, v in zip(("bytes", "parity", "outside", "inside"), sums.tolist())}})

    for of, parts in _same_block(batches):
        if now != (of["file"], of["block"], of["size"]):
            if now:
                yield row()
            now, sums = (of["file"], of["block"], of["size"]), np.zeros(4, np.int64)
        data = b"}".join(parts) + b"}"
        _, sign, odd, parity = _brackets(data)
        odd = odd ^ sums[1]
        sums += np.array([len(data), 0, sign[odd == 0].sum(), sign[odd == 1].sum()])
        sums[1] ^= parity
    if now:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that lie within a split, and the pieces at its two ends."""
    now = None

    def advance(data: bytes) -> tuple[list[tuple], bytes]:
        nonlocal seq, begun, key
        out, start = [], 0
        if not begun:  # up to the first end of an entry all belongs to the split before
            at, sign, odd, _ = _brackets(data)
            outside = odd == in_string
            at, sign = at[outside], sign[outside]
            ends = at[(sign < 0) & (depth + np.cumsum(sign) == 2)]
            ends = ends[np.frombuffer(data, np.uint8)[ends] == 125]
            if not len(ends):
                return [], data
            start, begun = int(ends[0]) + 1, True
            out.append((*now, seq, None, None, None, None, data[:start], True, 2))
            seq += 1
        found, end = _units(data[start:], 0 if first and not seq else 2)
        for own, entry, sound, skeleton in found:
            key = key if own is None else own
            out.append((*now, seq, key, entry, sound, skeleton, None, None, None))
            seq += 1
        return out, data[start + end :]

    def finish() -> list[tuple]:
        out, left = advance(rest + b"}".join([*held, b""]))
        return out + ([(*now, seq, None, None, None, None, left, False, 0 if first and not seq else 2)] if left else [])

    for of, parts in _same_block(batches):
        if now != (of["file"], of["block"]):
            if now and (out := finish()):
                yield _cut_rows(out)
            now, in_string, depth, first = (of["file"], of["block"]), of["in_string"], of["depth"], of["first"]
            seq, begun, key, held, size, rest = 0, first, None, [], 0, b""
        held += parts
        size += sum(map(len, parts))
        if size >= max(SCAN_BYTES, 2 * len(rest)):
            out, rest = advance(rest + b"}".join([*held, b""]))
            held, size = [], 0
            if out:
                yield _cut_rows(out)
    if now and (out := finish()):
        yield _cut_rows(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries put together from pieces (file, block, depth, pieces, closed); what no entry closes is the end of its file."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = b"".join(r["pieces"])
            found, end = _units(text, r["depth"])
            out += [(r["file"], r["block"], OVER, *unit, None, None, None) for unit in found]
            if not r["closed"]:
                out.append((r["file"], r["block"], END, None, None, True, text[end:], None, None, None))
        if out:
            yield _cut_rows(out)


def json_array_entries(spark: SparkSession, folder: str, pattern: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(entries, bad): the objects in the array ``key`` of each matching file, as (file, entry); the files that are no such JSON.

    A file of any size is read by as many tasks as it has splits (``spark.sql.files.maxPartitionBytes``).
    A file is bad if any part of it is not valid JSON, or if ``key`` is not an array in its outermost
    object; none of its entries is returned. Files of no bytes, which Spark's readers skip, are neither. Entries that are no objects are left out.
    Only a few short rows a split are ordered within a file.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    text = files.option("lineSep", "}").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("part"))
    measured = stored(text.select("file", "block", "size", "part").mapInArrow(_measure, "file string, block long, size long, bytes long, parity long, outside long, inside long"), "json-splits")

    in_file = Window.partitionBy("file")
    before = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    placed = measured.withColumn("in_string", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).withColumn("change", change)
    states = placed.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("int").alias("depth"), (F.col("block") == F.min("block").over(in_file)).alias("first"))
    rows = text.drop("size").join(states, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).drop("_file", "_block")
    cut = stored(rows.sortWithinPartitions("file", "block", "at").mapInArrow(_cut, _CUT), "json-cut")

    # a piece and those before it that no entry has closed make one text
    pieces = cut.filter("piece is not null").select("file", "block", "seq", "piece", "closes", "depth")
    group = F.coalesce(F.sum(F.col("closes").cast("int")).over(in_file.orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gathered = pieces.withColumn("group", group).groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "piece", "depth"))).alias("p"), F.max("closes").alias("closed"))
    over = stored(gathered.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["depth"].alias("depth"), F.col("p.piece").alias("pieces"), "closed").mapInArrow(_joined, _CUT), "json-over")
    every = cut.filter("piece is null").unionByName(over).select("file", "block", "seq", "key", "sound", "skeleton", F.col("entry").cast("string").alias("entry"))

    # an entry before any container of its split opens is in the container that was open before
    of_block = every.filter("skeleton is not null and entry is not null").groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(F.max_by("key", "seq").alias("last"), F.max_by(F.when(F.col("seq") < OVER, F.col("key")), F.when(F.col("seq") < OVER, F.col("seq"))).alias("within"))
    known = measured.select("file", "block").join(of_block, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left")
    carried = known.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "within", F.last("last", ignorenulls=True).over(before).alias("carried"))
    keyed = every.filter("entry is not null").join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    container = F.coalesce("key", F.when(F.col("seq") >= OVER, F.coalesce("within", "carried")).otherwise(F.col("carried")))

    # the reader does not tell whether a brace or the end of the file closed the last part
    unclosed = placed.groupBy("file").agg(((F.sum("bytes") == F.max("size") + 1) | ((F.sum("bytes") != F.max("size")) & (F.sum("change") == -1))).alias("unclosed"))
    skeletons = every.filter("skeleton is not null").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "skeleton"))), lambda x: x["skeleton"].cast("string")), "").alias("skeleton"))
    whole = F.when(F.col("unclosed"), F.expr("substring(skeleton, 1, length(skeleton) - 1)")).otherwise(F.col("skeleton"))
    framed = skeletons.join(unclosed, "file").select("file", F.try_parse_json(whole).alias("frame"))
    faulty = every.filter("entry is not null").filter(~F.col("sound") | F.try_parse_json("entry").isNull()).select("file").distinct()
    good = stored(framed.filter(F.expr(f"schema_of_variant(try_variant_get(frame, '$.{key}', 'variant')) like 'ARRAY%'")).select("file").join(faulty, "file", "left_anti"), "json-good")
    bad = files.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file")).join(good, "file", "left_anti")
    return keyed.filter(container == key).select("file", "entry").join(good, "file", "left_semi"), bad
