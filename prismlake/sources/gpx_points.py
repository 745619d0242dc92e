"""GPX files of any size, read in byte ranges by many tasks.

Spark's text reader cuts a file at end tags, in splits of any size, on any store it can read. Each
task takes runs of whole point elements out of its split and leaves an empty element in the place of
each run. Runs are parsed by themselves; what is left of a file, with the points that reach over the
end of a split, is short, and is put together and parsed as one document. It decides whether the file is
GPX and which runs lie where points are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored
from .json_array import _same_block

#: Bytes of a split that are scanned at a time, and about the most of a run. Spark's XML parser copies an array for each entry it adds.
RUN_BYTES = 1 << 17
#: Where the reader cuts; it may stand in a comment, but in no start tag of well-formed XML.
CUT = "</"

_POINT = "array<struct<_lat:double,_lon:double,time:string,name:string,cmt:string,desc:string{more}>>"
_ELEMENT = r"<{n}(?:\s[^<>]*+)?(?:(?<=/)>|(?<!/)>[^<]*+(?:<(?![!?]|/?{n}[\s/>])[^<]*+)*+</{n}\s*+>)"
_RUN = re.compile("|".join(rf"(?P<{n}>(?:{_ELEMENT.format(n=n)}\s*+)++)" for n in ("trkpt", "wpt", "rtept")).encode())
_MARKUP = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", re.S)
_GPX_START = r"(?s)\A\ufeff?\s*(<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(\w+:)?gpx[\s>/]"
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("gap", pa.binary()), ("kind", pa.string()), ("run", pa.binary()), ("odd", pa.bool_())])


def _odd(gap: bytes) -> bool:
    """Whether a comment, a CDATA section or the like is open at the end of ``gap``, which begins in none; a document type counts too."""
    if b"<!" not in gap and b"<?" not in gap:
        return False
    rest = _MARKUP.sub(b"", gap)
    return b"<!" in rest or b"<?" in rest


def _pieces(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each split, in order: what lies before a run, and the run; at last what lies after all runs."""
    cut, now, seq, held, size, rest = CUT.encode(), None, 0, [], 0, b""

    def cut_runs(last: bool) -> pa.RecordBatch | None:
        nonlocal seq, held, size, rest
        text = rest + cut.join([*held, b""])
        rows, at = [], 0
        for m in _RUN.finditer(text):
            gap = text[at : m.start()]
            rows.append((*now[:2], seq, now[2], gap, m.lastgroup, m.group(), _odd(gap)))
            seq, at = seq + 1, m.end()
        held, size, rest = [], 0, text[at:]
        if last:
            rows.append((*now[:2], seq, now[2], rest, None, None, _odd(rest)))
            seq, rest = 0, b""
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES) if rows else None

    for of, parts in _same_block(batches):
        key = (of["file"], of["block"], of["size"])
        if now and now != key:
            yield cut_runs(True)
        now = key
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= max(run_bytes, 2 * len(rest)) and (out := cut_runs(False)):
                yield out
    if now:
        yield cut_runs(True)


def gpx_points(spark: SparkSession, folder: str, pattern: str = "*.gpx", run_bytes: int = RUN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(points, bad) of the matching files: (file, kind, point), and the files without a ``gpx`` element around well-formed XML.

    Files of blanks alone are neither. All splits of a file are read where they lie. A file with a
    comment, a CDATA section or the like that reaches over a split or round a point, and one with a
    document type, is put together whole in one task, as is all of a file that is no point: tracks,
    segments, and points that hold such markup.
    """
    mark = "run" + uuid.uuid4().hex
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", CUT).text(folder)
    cut = stored(text.select(*meta, F.col("value").cast("binary").alias("part")).mapInArrow(partial(_pieces, run_bytes=run_bytes), "file string, block long, seq long, size long, gap binary, kind string, run binary, odd boolean"), "gpx-pieces")

    plain = _POINT.format(more="")
    runs = cut.filter("run is not null").select("file", "block", "seq", F.from_xml(F.concat(F.lit("<s>"), F.col("run").cast("string"), F.lit("</s>")), f"trkpt {plain}, wpt {plain}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("g"))
    parsed = stored(runs.select("file", "block", "seq", F.col("g._corrupt").isNotNull().alias("broken"), F.explode_outer(F.coalesce("g.trkpt", "g.wpt")).alias("point")), "gpx-runs")

    # a run that does not parse is put back, and so are all of a file whose text might hide where its elements are
    odd = stored(cut.groupBy("file").agg(F.max("odd").alias("odd_file")).filter("odd_file"), "gpx-odd")
    broken = stored(parsed.filter("broken").select("file", "block", "seq").distinct().withColumn("broken", F.lit(True)), "gpx-broken")
    marked = cut.join(odd, "file", "left").join(broken, ["file", "block", "seq"], "left")
    kept = F.coalesce(F.col("odd_file"), F.col("broken"), F.lit(False))
    place = F.concat(F.lit("<"), F.col("kind"), F.lit(f' {mark}="'), F.col("block"), F.lit("-"), F.col("seq"), F.lit('"/>'))
    piece = F.concat(F.col("gap").cast("string"), F.coalesce(F.when(kept, F.col("run").cast("string")).otherwise(place), F.lit("")))
    pieces = marked.select("file", "block", "seq", "size", piece.alias("piece"))
    gathered = pieces.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))), lambda p: p["piece"]), "").alias("ended"), F.max("size").alias("size"))
    # the reader does not tell whether its mark or the end of the file closed the last part
    documents = gathered.select("file", "size", F.expr(f"substring(ended, 1, length(ended) - {len(CUT)})").alias("value"))
    point = _POINT.format(more=f",_{mark}:string")
    shape = f"trk array<struct<trkseg:array<struct<trkpt:{point}>>>>, wpt {point}, _corrupt string"
    read = documents.select("file", "size", "value", F.from_xml("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("g"))
    # an HTML page parses too, to a row of nulls
    is_gpx = F.coalesce(F.col("g").isNotNull() & F.col("g._corrupt").isNull() & F.col("value").rlike(_GPX_START), F.lit(False))
    blank = (F.trim("value") == "") & (F.octet_length("value") == F.col("size"))
    whole = stored(read.select("file", is_gpx.alias("is_gpx"), blank.alias("blank"), F.when(is_gpx, F.col("g")).alias("g")), "gpx-documents")

    tracks = whole.filter("is_gpx").select("file", F.explode("g.trk").alias("t")).select("file", F.explode("t.trkseg").alias("s")).select("file", F.lit("trkpt").alias("kind"), F.explode("s.trkpt").alias("p"))
    found = tracks.unionByName(whole.filter("is_gpx").select("file", F.lit("wpt").alias("kind"), F.explode("g.wpt").alias("p")))
    fields = ["_lat", "_lon", "time", "name", "cmt", "desc"]
    single = found.filter(F.col(f"p._{mark}").isNull()).select("file", "kind", F.struct(*[F.col(f"p.{c}").alias(c) for c in fields]).alias("point"))
    named = F.split(F.col(f"p._{mark}"), "-")
    places = stored(found.filter(F.col(f"p._{mark}").isNotNull()).select("file", named[0].cast("long").alias("block"), named[1].cast("long").alias("seq"), "kind"), "gpx-places")
    many = parsed.filter("not broken").join(places, ["file", "block", "seq"]).select("file", "kind", "point")
    return single.unionByName(many), whole.filter("not is_gpx and not blank").select("file")
