"""Lines that many documents share, found by a sharded minimal perfect hash over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minimal_hash import MinimalHash

SPACE = " \t\n\x0b\x0c\r"
#: Line hashes of a block of documents, and of a shard of the index.
BLOCK_LINES, SHARD_KEYS = 1 << 16, 1 << 13
_MOST_COUNT = 2**32 - 1
_PAIR = np.dtype([("key", "<u8"), ("mark", "<u4")])


def _keys(lines: list[str], least_chars: int) -> tuple[list[int], np.ndarray]:
    """Places of the lines that are long enough, and their keys' hashes: 64 and 32 bits."""
    places, digests = [], []
    for k, line in enumerate(lines):
        if len(line) >= least_chars:
            bare = line.strip(SPACE)
            if len(bare) >= least_chars:
                places.append(k)
                digests.append(xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower()))
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
    found = np.empty(len(places), _PAIR)
    found["key"], found["mark"] = both[:, 1], both[:, 0] >> np.uint64(32)
    return places, found


def _blocks(docs: DataFrame, least_chars: int) -> DataFrame:
    """(block, ids, ends, lines): the distinct long-line hashes of some documents with an id a row; ``ends`` close each one's."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block, ids, held, ends, size = (context.partitionId() if context else 0) << 32, [], [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": [np.array(ids, "<i8").tobytes()], "ends": [np.array(ends, "<i8").tobytes()], "lines": [np.concatenate(held).tobytes()]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(_keys((text.as_py() or "").split("\n"), least_chars)[1])
                if doc_id is None or not len(own):
                    continue
                ids.append(doc_id)
                held.append(own)
                size += len(own)
                ends.append(size)
                if size >= BLOCK_LINES:
                    yield full()
                    block, ids, held, ends, size = block + 1, [], [], [], 0
        if ids:
            yield full()

    return stored(docs.mapInArrow(pack, "block long, ids binary, ends binary, lines binary"), "line-blocks")


def _owners(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's line hashes and the document of each."""
    ends = np.frombuffer(row["ends"], "<i8")
    return np.frombuffer(row["lines"], _PAIR), np.repeat(np.frombuffer(row["ids"], "<i8"), np.diff(ends, prepend=0))


def line_index(blocks: DataFrame, least_docs: int = 2) -> DataFrame:
    """The shards (shard, shards, hash, prints, counts, keepers) over all distinct line hashes of at least ``least_docs`` documents.

    Counts and the largest id are summed up in each block, then by hash. A shard is a minimal perfect
    hash with arrays in its order: 64-bit fingerprints, numbers of documents (up to 2**32 - 1), and
    the largest document that holds the line. A shard has about ``SHARD_KEYS`` lines.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines, owner = _owners(row)
                own, place, n = np.unique(lines, return_inverse=True, return_counts=True)
                largest = np.full(len(own), np.iinfo(np.int64).min)
                np.maximum.at(largest, place, owner)
                yield pa.RecordBatch.from_arrays([pa.array(own["key"].view("<i8")), pa.array(own["mark"].astype("<i8")), pa.array(n.astype("<i8")), pa.array(largest)], names=["key", "mark", "n", "keeper"])

    each = blocks.mapInArrow(count, "key long, mark long, n long, keeper long")
    counted = stored(each.groupBy("key", "mark").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).filter(F.col("n") >= least_docs), "line-counts")
    shards = max(1, -(-counted.count() // SHARD_KEYS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def full() -> pa.RecordBatch:
            rows = np.concatenate(held)
            keys, marks = rows[:, 1].view("<u8"), rows[:, 2].astype("<u4")
            table = MinimalHash.build(keys, marks)
            order = np.argsort(table.numbers(keys, marks))
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "shards": pa.array([shards], pa.int64()), "hash": [table.to_bytes()], "prints": [keys[order].tobytes()], "counts": [np.minimum(rows[order, 3], _MOST_COUNT).astype("<u4").tobytes()], "keepers": [rows[order, 4].tobytes()]})

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for part in np.split(rows, cuts):
                if not len(part):
                    continue
                if held and part[0, 0] != now:
                    yield full()
                    held = []
                now = int(part[0, 0])
                held.append(part)
        if held:
            yield full()

    dealt = counted.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "mark", "n", "keeper").repartition("shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(build, "shard long, shards long, hash binary, prints binary, counts binary, keepers binary"), "line-index")


def _shared_lines(blocks: DataFrame, index: DataFrame, least_docs: int) -> DataFrame:
    """(doc, lines): for each document the hashes of its lines that ``least_docs`` documents share and a larger one keeps.

    Each block asks a shard once for each of its distinct lines, so a line of any number of
    documents is asked for once a block. Shards and questions, and then answers and blocks, pass
    through tasks as sorted streams; no task holds more than a shard and a block.
    """
    first = index.select("shards").first()
    shards = first["shards"] if first else 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = np.unique(np.frombuffer(row["lines"], _PAIR))
                shard = np.mod(lines["key"].view("<i8"), shards) if len(lines) else np.zeros(0, np.int64)
                order = np.argsort(shard, kind="stable")
                numbers, at = np.unique(shard[order], return_index=True)
                parts = np.split(lines[order], at[1:])
                yield pa.RecordBatch.from_pydict({"shard": pa.array(numbers, pa.int64()), "block": pa.array([row["block"]] * len(numbers), pa.int64()), "lines": pa.array([p.tobytes() for p in parts], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["hash"] is not None:
                    now = row["shard"]
                    table, prints, counts, keepers = MinimalHash.from_bytes(row["hash"]), np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["keepers"], "<i8")
                elif row["shard"] == now:
                    lines = np.frombuffer(row["lines"], _PAIR)
                    number = table.numbers(np.ascontiguousarray(lines["key"]), lines["mark"])
                    hit = (number >= 0) & (prints[number] == lines["key"]) & (counts[number] >= least_docs)
                    if hit.any():
                        yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int64()), "lines": [lines[hit].tobytes()], "keepers": [keepers[number[hit]].tobytes()]})

    asked = blocks.select("block", "lines").mapInArrow(ask, "shard long, block long, lines binary")
    both = index.select("shard", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("lines"), "hash", "prints", "counts", "keepers").unionByName(asked, allowMissingColumns=True)
    sorted_ = both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    answers = sorted_.mapInArrow(answer, "block long, lines binary, keepers binary")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    now, told = row["block"], []
                if row["keepers"] is not None:
                    told.append((np.frombuffer(row["lines"], _PAIR), np.frombuffer(row["keepers"], "<i8")))
                elif told:
                    known, keeper = (np.concatenate(c) for c in zip(*told))
                    order = np.argsort(known)
                    known, keeper = known[order], keeper[order]
                    lines, owner = _owners(row)
                    at = np.minimum(np.searchsorted(known, lines), len(known) - 1)
                    goes = (known[at] == lines) & (keeper[at] != owner)
                    if goes.any():
                        key, of = lines["key"][goes].view("<i8"), owner[goes]
                        cuts = np.flatnonzero(np.diff(of)) + 1
                        yield pa.RecordBatch.from_pydict({"doc": pa.array(of[np.r_[0, cuts]]), "lines": pa.array([p.tolist() for p in np.split(key, cuts)], pa.list_(pa.int64()))})

    told = answers.select("block", "lines", "keepers", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("ends"))
    met = told.unionByName(blocks.select("block", "lines", F.lit(None).cast("binary").alias("keepers"), "ids", "ends"))
    found = met.repartition("block").sortWithinPartitions("block", F.col("ids").isNotNull()).mapInArrow(drop, "doc long, lines array<long>")
    return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def dedup_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Documents without the lines that ``least_docs`` of them share, but for the largest id that holds each.

    Columns: id, ``n_lines``, ``n_dropped``, ``kept`` (the text left). A text is split at ``\n``; a null
    or empty one is one empty line. A line's key is the line without ASCII white space at both ends,
    A-Z lower-cased; keys below ``least_chars`` code points never go. Keys are told apart by 96 bits
    of their hash. A document counts once for a key, however often it repeats it, and the keeper
    keeps all its repeats. Rows that repeat an id are a document each when counted, and keep or lose
    a key together. Rows without an id take no part: they count for nothing and keep all lines. Texts
    of any length count whole; other columns are ignored, whatever their names; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body"))
    blocks = _blocks(rows, least_chars)
    shared = _shared_lines(blocks, line_index(blocks), least_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                body = text.as_py() or ""
                if gone.is_valid:
                    lines = body.split("\n")
                    places, own = _keys(lines, least_chars)
                    goes = {k for k, out in zip(places, np.isin(own["key"].view("<i8"), np.asarray(gone.values))) if out}
                    n_lines.append(len(lines))
                    n_dropped.append(len(goes))
                    body = "\n".join(line for k, line in enumerate(lines) if k not in goes)
                else:
                    n_lines.append(body.count("\n") + 1)
                    n_dropped.append(0)
                kept.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_lines", "n_dropped", "kept"])

    told = rows.join(shared.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left").select("doc", "body", "lines")
    return told.mapInArrow(cut, "doc long, n_lines long, n_dropped long, kept string").withColumnRenamed("doc", id_col)
