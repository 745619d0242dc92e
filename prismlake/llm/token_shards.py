"""Token-id output: write documents as sorted shards and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch_path, stored
from .pieces import byte_batches, id_width, worker_encoder
from .sstable import ShardReader, ShardWriter, document_key

#: Shards are read in a stated number of tasks: adaptive coalescing cannot see how large they are.
MOST_TASKS = 20_000

_MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write them in ascending id order.

    Texts are encoded where they are read and stored as ids; these, not the texts, are then
    range-partitioned by id, each partition writes shards of at most about ``shard_bytes``, and the
    result is the stored manifest: part, seq, path, n_docs, n_ids. A retried task writes new files
    and only the files of the task that ended well are in the manifest. Null and empty texts hold
    just the end id, null ids sort first, repeated ids are all kept, in an order that their ids
    decide, so reruns agree; a document longer than a shard makes one of its own; other columns are
    ignored, whatever their names; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    target = folder or scratch_path(spark, "token-shards")
    width = id_width(tokenizer_path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = worker_encoder(tokenizer_path), f"<u{width}"
        for batch in batches:
            at = 0
            for texts in byte_batches(batch.column(1)):
                data, places = encoder.encode(texts)
                ended = np.insert(data, places[1:], end_id).astype(kind)
                ends = ((places + np.arange(len(places))) * width).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ended)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=["id", "ids"])
                at += len(texts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.attemptNumber()) if context else (0, 0)
        files, root = file_system(target)
        files.create_dir(root, recursive=True)
        shard = sink = None
        path, seq, last, repeat = "", 0, object(), 0

        def done() -> pa.RecordBatch:
            shard.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": shard.entries, "n_ids": shard.ids}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is not None and shard.size >= shard_bytes:
                    yield done()
                    shard, seq = None, seq + 1
                if shard is None:
                    name = f"part-{part:06d}-{seq:05d}-{attempt}-{uuid.uuid4().hex[:8]}.sst"
                    path = f"{target}/{name}"
                    sink = files.open_output_stream(f"{root}/{name}")
                    shard = ShardWriter(sink, width)
                repeat = repeat + 1 if doc_id == last else 0
                last = doc_id
                shard.add(document_key(doc_id, repeat), ids.as_py())
        if shard is not None:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    encoded = stored(rows.mapInArrow(encode, "id long, ids binary").withColumn("draw", F.xxhash64("ids")), "token-ids", compression="zstd")
    # equal ids may fill several partitions, in the order of the draw
    ordered = encoded.repartitionByRange("id", "draw").sortWithinPartitions("id", "draw", "ids").select("id", "ids")
    return stored(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the shards that ``manifest`` names, with their ids and global place.

    Columns: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit). Only the list of shards, one short row a shard, is ordered in one task.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("first")).repartition(max(1, min(manifest.count(), MOST_TASKS)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                files, path = file_system(row["path"])
                start, held, size = row["first"], [], 0
                with files.open_input_file(path) as source:
                    for doc_id, ids in ShardReader(source):
                        data = ids.astype("<u4").tobytes()
                        held.append((doc_id, start, len(ids), data))
                        start += len(ids)
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return placed.mapInArrow(read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
