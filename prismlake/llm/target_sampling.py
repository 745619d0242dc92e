"""Documents resampled to resemble a target text: importance weights over hashed word runs, drawn by Gumbel scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import word_lists

#: Words and pairs of the head vocabulary, and the longest word in it: with these it stays below some 5 MB.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 30_000, 30_000, 64
#: A task's counts are handed on when it holds so many words.
_FLUSH = 200_000


class HeadVocabulary:
    """CRC states of frequent words and buckets of frequent pairs of them; every other feature takes its CRC directly."""

    def __init__(self, words: list[bytes], pairs: np.ndarray, buckets: int):
        self.words, self.buckets = words, buckets
        self.number = {w: k for k, w in enumerate(words)}
        self.state = np.array([*map(zlib.crc32, words), 0], np.int64)
        self.pairs = np.sort(pairs)
        first, second = np.divmod(self.pairs, max(1, len(words)))
        self.pair_bucket = np.array([zlib.crc32(b" " + words[b], int(self.state[a])) % buckets for a, b in zip(first.tolist(), second.tolist())], np.int64)

    def pair_codes(self, words: list[bytes]) -> np.ndarray:
        """A number for each two neighbours that are both in the head, else -1."""
        at = np.array([self.number.get(w, -1) for w in words], np.int64)
        return np.where((at[:-1] < 0) | (at[1:] < 0), -1, at[:-1] * len(self.words) + at[1:])

    def features(self, words: list[bytes], most_words: int, repeats: int = 0) -> list[np.ndarray]:
        """Buckets of the runs of 1, 2, .. ``most_words`` words, but those within the first ``repeats`` words."""
        get = self.number.get
        at = np.array([get(w, -1) for w in words], np.int64)
        state = self.state[at]
        for k in np.flatnonzero(at < 0).tolist():
            state[k] = zlib.crc32(words[k])
        found = [state[repeats:] % self.buckets]
        for size in range(2, most_words + 1):
            start = max(0, repeats - size + 1)
            n = max(0, len(words) - size + 1 - start)
            bucket, open_ = np.zeros(n, np.int64), np.ones(n, bool)
            if size == 2 and len(self.pairs) and n:
                code = self.pair_codes(words)[start:]
                place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                open_ = self.pairs[place] != code
                bucket = np.where(open_, 0, self.pair_bucket[place])
            for k in np.flatnonzero(open_).tolist():
                crc = int(state[start + k])
                for word in words[start + k + 1 : start + k + size]:
                    crc = zlib.crc32(b" " + word, crc)
                bucket[k] = crc % self.buckets
            found.append(bucket)
        return found


def head_vocabulary(docs: DataFrame, buckets: int, most_words: int, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, text_col: str = "text") -> HeadVocabulary:
    """The most frequent words of all texts and, where runs of two count, the most frequent pairs of these.

    Counts are exact and cover every text. The head is all words above a count, which is set so that
    they are at most ``head_words``; only a tally of counts, in steps of an eighth of a doubling, and the head
    itself come to the driver. What is in the head changes the work, never a result.
    """
    spark, texts = docs.sparkSession, docs.select(F.col(f"`{text_col}`").alias("body"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def full() -> pa.RecordBatch:
            short = {w: n for w, n in held.items() if len(w) <= HEAD_BYTES}
            return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.binary()), pa.array(short.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for words, _ in word_lists(text.as_py()):
                    held.update(words)
                if len(held) > _FLUSH:
                    yield full()
                    held.clear()
        yield full()

    def most_frequent(counted: DataFrame, name: str, most: int) -> list:
        step = F.floor(F.log2("n") * 8).cast("int").alias("step")
        summed = stored(counted.groupBy(name).agg(F.sum("n").alias("n")).select(name, step), "target-head")
        held, least = 0, 1 << 20
        for r in sorted(summed.groupBy("step").count().collect(), reverse=True):
            held += r["count"]
            if held > most:
                break
            least = r["step"]
        return sorted(r[name] for r in summed.filter(F.col("step") >= least).select(name).collect())

    words = [bytes(w) for w in most_frequent(texts.mapInArrow(count_words, "word binary, n long"), "word", head_words)]
    head = HeadVocabulary(words, np.zeros(0, np.int64), buckets)
    if most_words < 2:
        return head
    shared = spark.sparkContext.broadcast(head)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for text in batch.column(0):
                for words_, _ in word_lists(text.as_py(), 1):
                    code = shared.value.pair_codes(words_)
                    held.append(code[code >= 0])
            if sum(map(len, held)) > 10 * _FLUSH:
                yield full()
                held.clear()
        yield full()

    return HeadVocabulary(words, np.array(most_frequent(texts.mapInArrow(count_pairs, "pair long, n long"), "pair", head_pairs), np.int64), buckets)


def _featured(docs: DataFrame, head, most_words: int, id_col: str | None, text_col: str) -> DataFrame:
    """(doc, n_words, n_features, buckets, totals): a row a document with its features' buckets, and a row a task with its totals by bucket."""
    rows = docs.select((F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")).alias("doc"), F.col(f"`{text_col}`").alias("body"))
    kind = "<u2" if head.value.buckets <= 1 << 16 else "<u4"

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        totals = np.zeros(known.buckets, np.int64)
        names, types = ["doc", "n_words", "n_features", "buckets", "totals"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            n_words, n_features, buckets = [], [], []
            for text in batch.column(1):
                n, parts = 0, [np.zeros(0, np.int64)]
                for words, repeats in word_lists(text.as_py(), most_words - 1):
                    n += len(words) - repeats
                    parts += known.features(words, most_words, repeats)
                every = np.concatenate(parts)
                totals += np.bincount(every, minlength=known.buckets)
                n_words.append(n)
                n_features.append(len(every))
                buckets.append(every.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((n_words, n_features, buckets, [None] * batch.num_rows), types[1:]))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, totals.tobytes()), types)], names=names)

    return stored(rows.mapInArrow(featurise, "doc long, n_words long, n_features long, buckets binary, totals binary"), "target-features", compression="zstd")


def _totals(featured: DataFrame, buckets: int) -> np.ndarray:
    """Exact occurrences by bucket: a bounded array, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    summed = featured.filter("totals is not null").select("totals").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in summed.collect():
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the corpus, both smoothed by one."""
    all_have, all_want, n = int(have.sum()), int(want.sum()), len(have)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_have + n) / (float(s + 1) * float(all_want + n)))) for s, t in zip(have.tolist(), want.tolist())], np.int64)


def _ranked(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` with ``rank``, from 1, by falling score and rising id; null beyond ``draw``.

    Rows are range-partitioned in that order, numbered as they lie, and shifted by the rows of the
    partitions before, of which there is one short row each.
    """
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("n_features")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(laid.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "target-places")
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    at = F.col("place") + F.col("shift")
    return numbered.join(shifts, "part").select(*rows.columns, F.when(at <= draw, at).alias("rank"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, most_words: int = 1, least_words: int = 20, seed: int = 2024, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's weight towards ``target``, and the rank of those drawn without replacement.

    Columns: id, ``n_features``, ``weight``, ``score``, ``rank`` (null where not drawn). Features are all
    runs of 1 to ``most_words`` words, hashed by CRC-32 into ``buckets``; a document's weight is the sum
    of its features' gains (``bucket_gains``). The score adds a Gumbel draw that the id and ``seed``
    decide, so reruns agree; of the documents with at least ``least_words`` words, ``percent`` in a
    hundred with the highest scores are drawn, ties to the smaller id. Null and empty texts have no
    features and weight 0; a null id draws as an empty one and comes last among ties; rows that
    repeat an id are ranked each; texts of any length count whole; other columns are ignored,
    whatever their names; without a target all gains follow from the smoothing alone; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(head_vocabulary(docs, buckets, most_words, head_words, head_pairs, text_col))
    featured = _featured(docs, head, most_words, id_col, text_col)
    wanted = _featured(target, head, most_words, None, text_col)
    gains = spark.sparkContext.broadcast(bucket_gains(_totals(featured, buckets), _totals(wanted, buckets)))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains.value[np.frombuffer(b.as_buffer(), kind)].sum()) for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=["doc", "n_words", "n_features", "weight"])

    weighed = featured.filter("totals is null").select("doc", "n_words", "n_features", "buckets").mapInArrow(weigh, "doc long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel), "target-scores")
    able = scored.filter(F.col("n_words") >= least_words)
    ranked = _ranked(able, percent * able.count() // 100)
    every = ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("doc").alias(id_col), "n_features", "weight", "score", "rank")
