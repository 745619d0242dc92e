"""WARC archives written from, and read back as, a table of payload chunks."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, scratch_path, stored

CHUNK_BYTES = 256 << 10
#: Smaller payloads are stored again and not referred to.
LEAST_REVISIT_BYTES = 1000
MOST_TASKS = 20_000
_RECORD_ID = "<urn:uuid:%s>"
_CHUNKS = "record string, n int, last boolean, page_id long, url string, payload_bytes long, digest string, refers_to long, chunk binary"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """``pages`` with payload, payload_bytes, digest (SHA-1, hex) and refers_to.

    Of equal payloads of at least ``least_bytes`` the one with the largest id is stored, the others
    refer to it. Rows that repeat that id are each stored. Null ids are stored and never referred to.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload", payload).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    keys = rows.select(F.col(id_col).alias("_id"), "digest", "payload_bytes").filter(F.col("_id").isNotNull() & (F.col("payload_bytes") >= least_bytes))
    keys = stored(keys.distinct(), "warc-keys")
    chief = keys.groupBy("digest").agg(F.max("_id").alias("chief"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = keys.join(chief, "digest").filter("_id <> chief").select("_id", F.col("digest").alias("_digest"), F.col("chief").alias("refers_to"))
    joined = rows.join(revisits, (F.col(id_col) == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.drop("_id", "_digest")


def chunk_table(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(record, n, last, ..., chunk): payloads cut into rows; a revisit has one empty chunk.

    ``record`` names page and payload and stays the same over retries; rows alike in both share it.
    """
    record = F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "digest")
    cut = planned.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))).withColumn("record", record)
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk_bytes).cast("int"))
    # numbers are exploded, and each chunk is cut from the one body as its row passes
    rows = cut.withColumn("pieces", pieces).select("record", "pieces", "body", F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), "payload_bytes", "digest", "refers_to", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("n"))
    chunk = F.substring("body", F.col("n") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk")
    return rows.select("record", "n", (F.col("n") == F.col("pieces") - 1).alias("last"), "page_id", "url", "payload_bytes", "digest", "refers_to", chunk)


def _record_id(record: str) -> str:
    return _RECORD_ID % uuid.uuid5(uuid.NAMESPACE_URL, record)


def _head(row: dict) -> bytes:
    """The header lines of a record and, of a response, those of the HTTP message that holds the payload."""
    revisit = row["refers_to"] is not None
    message = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        "WARC-Record-ID: " + _record_id(row["record"]),
        f"WARC-Target-URI: {(row['url'] or 'about:blank').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To: " + _record_id(f"{row['refers_to']}-{row['digest']}"), f"X-Refers-To-Page-ID: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(message) + (0 if revisit else row['payload_bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + message


def write_archives(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the chunks, which come in order within each partition, as one .warc.gz a partition.

    A record streams into its own gzip member chunk by chunk while its digest is carried along and
    held against the header's at the end. Returns the stored table of files: path, records. Only
    files of tasks that ended well are listed.
    """
    spark = chunks.sparkSession
    target = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        files, root = file_system(target)
        sink = packer = digest = None
        records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                if row["n"] == 0:
                    packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    sink.write(packer.compress(_head(row)))
                digest.update(row["chunk"])
                sink.write(packer.compress(row["chunk"]))
                if row["last"]:
                    if row["refers_to"] is None and digest.hexdigest() != row["digest"]:
                        raise ValueError(f"chunks of {row['record']} are out of order")
                    sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}"]), pa.array([records], pa.int64())], names=["path", "records"])

    return stored(chunks.mapInArrow(write, "path string, records long"), "warc-files")


class _Members:
    """Plain bytes of a file of gzip members, a buffer at a time."""

    def __init__(self, source):
        self._source, self._packer, self._left = source, zlib.decompressobj(31), b""

    def pull(self, most: int = 16 << 10) -> bytes:
        """The next bytes, at most about a thousand times ``most``; empty at the end."""
        while True:
            data = self._left or self._source.read(most)
            if not data:
                return b""
            if self._packer.eof:
                self._packer = zlib.decompressobj(31)
            out = self._packer.decompress(data)
            self._left = self._packer.unused_data
            if out:
                return out


def read_records(source) -> Iterator[dict]:
    """Records of an open archive: headers, and size and digest of the payload as it streams by; an archive cut short is an error.

    The payload is what follows the HTTP header in a response; a revisit has none.
    """
    plain, held = _Members(source), b""
    while True:
        while b"\r\n\r\n" not in held:
            more = plain.pull()
            if not more:
                if held.strip():
                    raise ValueError("archive ends inside a record")
                return
            held += more
        head, held = held.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left, digest = int(fields["Content-Length"]), hashlib.sha1()
        if fields["WARC-Type"] == "response":
            while b"\r\n\r\n" not in held:
                more = plain.pull()
                if not more:
                    raise ValueError("archive ends inside a record")
                held += more
            message, held = held.split(b"\r\n\r\n", 1)
            left -= len(message) + 4
        size = left
        while left:
            if not held:
                held = plain.pull()
                if not held:
                    raise ValueError("archive ends inside a record")
            part, held = held[:left], held[left:]
            digest.update(part)
            left -= len(part)
        while len(held) < 4:
            more = plain.pull()
            if not more:
                raise ValueError("archive ends inside a record")
            held += more
        held = held[4:]
        yield fields | {"digest": digest.hexdigest(), "size": size}


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in ``files``.

    Of a response both figures are taken from the body as read; of a revisit, which has no body,
    from its headers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                held = []
                with system.open_input_stream(place, compression=None) as source:
                    for r in read_records(source):
                        body = r["WARC-Type"] == "response"
                        values = (int(r["X-Page-ID"]) if r["X-Page-ID"] else None, r["size"] if body else int(r["X-Payload-Length"]), r["digest"] if body else r["WARC-Payload-Digest"][5:], r["WARC-Type"], None if body else int(r["X-Refers-To-Page-ID"]))
                        held.append(dict(zip(names, values)))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    # a stated number of tasks: these short rows stand for large files, which adaptive coalescing cannot see
    return files.select("path").repartition(max(1, min(files.count(), MOST_TASKS)), "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record and read the archives back.

    Null payloads are empty and null urls become about:blank; null ids come back null; rows that
    repeat are each a record; of equal payloads the largest id is stored, so there are no ties; very
    long payloads pass in chunks; an empty table gives no records. Columns besides page_id, url and
    html are ignored, whatever their names.
    """
    slim = pages.select("page_id", "url", "html")
    return read_archives(write_archives(chunk_table(plan_records(slim))))
