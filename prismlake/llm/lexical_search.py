"""Exact ranked lexical search by the best position algorithm over impact lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tiles import tile_pairs
from .words import word_lists

#: Documents and postings of a block, items of a block of queries.
BLOCK_DOCS, BLOCK_POSTINGS, BLOCK_ITEMS = 1 << 13, 1 << 18, 256
#: Bits of the filter that drops words no query can hold; its size is fixed, and a false hit costs only work.
FILTER_BITS = 23
#: Weight of a document's length, in hundredths.
LENGTH_SHARE = 75


class _TermHash(dict):
    """64-bit hash of a word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


def _counted(text: str | None) -> Counter:
    held: Counter = Counter()
    for words, _ in word_lists(text):
        held.update(words)
    return held


def term_counts(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(doc, n, terms, tf): of each row (doc, body) the number of its terms, and hash and count of each distinct one.

    Terms are told apart by 64 bits of their hash. With ``only``, a table of bits, terms whose
    bit is not set are counted in ``n`` but not listed.
    """
    bits = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _TermHash(), bits.value
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1):
                held = _counted(text.as_py())
                tf = np.fromiter(held.values(), np.int64, len(held))
                term = np.fromiter(map(hashes.__getitem__, held), np.uint64, len(held))
                n.append(int(tf.sum()))
                if known is not None:
                    listed = known[(term >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    term, tf = term[listed], tf[listed]
                terms.append(term.view("<i8"))
                counts.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["doc", "n", "terms", "tf"])

    return rows.mapInArrow(count, "doc long, n long, terms array<long>, tf array<long>")


def _term_filter(asked: DataFrame) -> np.ndarray:
    """One bit for the leading bits of each query term, or-ed up in tasks: ``FILTER_BITS`` decides its size, not the queries."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            held[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        packed = np.packbits(held).reshape(256, -1)
        used = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["slice", "bits"])

    bits = np.zeros((256, (1 << FILTER_BITS) // 8 // 256), np.uint8)
    marked = asked.select("term").distinct().mapInArrow(mark, "slice long, bits binary")
    for r in marked.toLocalIterator():
        bits[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(bits.ravel()).view(bool)


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays end to end, 4 bytes a number where these suffice."""
    slim = [a.astype("<i4" if not len(a) or (a.min() >= -(1 << 31) and a.max() < 1 << 31) else "<i8") for a in arrays]
    return np.array([[len(a), a.itemsize] for a in slim], "<i8").tobytes() + b"".join(a.tobytes() for a in slim)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    at, found = 16 * n, []
    for length, width in np.frombuffer(data, "<i8", 2 * n).reshape(-1, 2).tolist():
        found.append(np.frombuffer(data, f"<i{width}", length, at))
        at += length * width
    return found


def impact_blocks(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(tile, dims, ids, data): documents packed in blocks, each with its impact lists.

    ``data`` holds the block's terms, where each one's list starts, and the lists by falling impact
    (document, impact without the term's weight); then, for direct access, where each document's
    postings start and their places in the lists.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made = context.partitionId() if context else 0, 0
        docs, terms, tfs, lengths, size = [], [], [], [], 0

        def full() -> pa.RecordBatch:
            of = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
            term, tf = np.concatenate(terms), np.concatenate(tfs)
            m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in lengths], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[of])
            order = np.lexsort((of, -impact, term))
            term, of, impact = term[order], of[order], impact[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            places = np.argsort(of, kind="stable")
            data = _packed(term[starts], np.r_[starts, len(term)], of, impact, np.r_[0, np.cumsum(np.bincount(of, minlength=len(docs)))], places)
            return pa.RecordBatch.from_pydict({"tile": pa.array([(part << 32) + made], pa.int64()), "dims": pa.array([0], pa.int32()), "ids": [np.array(docs, "<i8").tobytes()], "data": [data]})

        for batch in batches:
            for doc, n, term, tf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                docs.append(doc)
                lengths.append(n)
                terms.append(term.values.to_numpy())
                tfs.append(tf.values.to_numpy())
                size += len(tfs[-1])
                if len(docs) == BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield full()
                    made, docs, terms, tfs, lengths, size = made + 1, [], [], [], [], 0
        if docs:
            yield full()

    usable = counted.filter("doc is not null and size(terms) > 0").select("doc", "n", "terms", "tf")
    return stored(usable.mapInArrow(pack, "tile long, dims int, ids binary, data binary"), "search-impacts", compression="zstd")


def _query_blocks(asked: DataFrame) -> DataFrame:
    """(tile, dims, ids, data) of rows (item, row, terms, weights), about ``BLOCK_ITEMS`` of them a block, however they lie."""
    asked = stored(asked, "search-weighed")
    asked = asked.repartition(max(1, -(-asked.count() // BLOCK_ITEMS)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made = context.partitionId() if context else 0, 0
        items, rows, terms, weights = [], [], [], []

        def full() -> pa.RecordBatch:
            data = _packed(np.cumsum([0, *map(len, terms)]), np.concatenate(terms), np.concatenate(weights), np.array(rows))
            return pa.RecordBatch.from_pydict({"tile": pa.array([(part << 32) + made], pa.int64()), "dims": pa.array([0], pa.int32()), "ids": [np.array(items, "<i8").tobytes()], "data": [data]})

        for batch in batches:
            for item, row, term, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                items.append(item)
                rows.append(row)
                terms.append(term.values.to_numpy())
                weights.append(weight.values.to_numpy())
                if len(items) == BLOCK_ITEMS:
                    yield full()
                    made, items, rows, terms, weights = made + 1, [], [], [], []
        if items:
            yield full()

    return stored(asked.mapInArrow(pack, "tile long, dims int, ids binary, data binary"), "search-items")


class ImpactBlock:
    """Impact lists of a block, searched by the best position algorithm."""

    def __init__(self, ids: np.ndarray, data: bytes):
        self.ids = ids
        self.terms, self.starts, self.docs, self.impacts, self.doc_starts, self.places = _unpacked(data, 6)
        self.list_of = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        self.weight = np.zeros(len(self.terms), np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 0) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), equal scores by the smaller id, and how many documents were scored.

        Lists are read from the top, a growing depth at a time. A document met is scored whole by
        direct accesses, which also tell its places in the other lists; a list's best position is the
        last one before which every place is seen. A document not met lies behind all of them, so it
        scores at most the sum of what the lists hold there, and the search stops when that sum is
        strictly below the kth score (or ``least``, a kth score found elsewhere).
        """
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (weights > 0)
        held[held] = self.terms[at[held]] == terms[held]
        lists, factor = at[held], weights[held]
        if not len(lists):
            return [], 0
        first, end = self.starts[lists].astype(np.int64), self.starts[lists + 1].astype(np.int64)
        self.weight[lists] = factor
        seen = np.zeros(len(self.docs), bool)  # by place in the lists
        met = np.zeros(len(self.ids), bool)
        score = np.zeros(len(self.ids), np.int64)
        position, depth, n_met = first.copy(), 16, 0
        while True:
            reached = np.minimum(first + depth, end)
            read = np.concatenate([np.arange(a, b) for a, b in zip(position, reached) if a < b] or [np.zeros(0, np.int64)])
            fresh = np.unique(self.docs[read])
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            n_met += len(fresh)
            if len(fresh):
                lengths = (self.doc_starts[fresh + 1] - self.doc_starts[fresh]).astype(np.int64)
                ends = np.cumsum(lengths)
                own = self.places[np.arange(ends[-1]) + np.repeat(self.doc_starts[fresh] - (ends - lengths), lengths)]
                seen[own] = True
                running = np.r_[0, np.cumsum(self.weight[self.list_of[own]] * self.impacts[own])]
                score[fresh] = running[ends] - running[ends - lengths]
            edge = 0
            for j, (a, b) in enumerate(zip(position.tolist(), end.tolist())):
                while a < b:
                    part = seen[a : min(b, a + 4 * depth)]
                    gap = int(part.argmin())
                    if not part[gap]:
                        a += gap
                        edge += int(factor[j]) * int(self.impacts[a])
                        break
                    a += len(part)
                position[j] = a
            if n_met >= k:
                own_scores = score[met]
                least = max(least, int(np.partition(own_scores, len(own_scores) - k)[len(own_scores) - k]))
            if (position >= end).all() or edge < least:
                break
            depth *= 2
        self.weight[lists] = 0
        good = np.flatnonzero(met & (score > 0) & (score >= least))
        good = good[np.lexsort((self.ids[good], -score[good]))][:k]
        return [(int(score[d]), int(self.ids[d])) for d in good], n_met


def lexical_top_k(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """For each item the ``k`` documents with the highest scores above 0.

    Columns: ``item_col``, rank (from 1), ``id_col``, score; equal scores go by the smaller id. A term's
    weight falls with the documents that hold it, its impact grows with its count in a document and
    falls with the document's length; all of it is whole numbers but for the weight's logarithm.
    Statistics cover all documents. Blocks of documents hold impact lists, each block answers a
    block of items by the best position algorithm, and the blocks' answers, ``k`` an item, are
    ranked. A task that goes from block to block keeps each item's kth score as the bar for the
    next. Null and empty texts hold no term and are never found; null ids count in the statistics
    but are never found; rows that repeat an id are candidates each; items alike in id and text
    are asked once, and items of one id with different texts are ranked apart; null items are left
    out; texts of any length count whole; other columns are ignored, whatever their names; without documents or items there are no rows.
    """
    asked = term_counts(items.select(F.col(f"`{item_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body")).filter("doc is not null").distinct())
    asked = stored(asked.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc").alias("item"), F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("row", "item", F.col("t.terms").alias("term"), F.col("t.tf").alias("times")), "search-asked")
    counted = stored(term_counts(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body")), _term_filter(asked)), "search-terms", compression="zstd")
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "df"])

    holders = counted.select("terms").mapInArrow(tally, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
    weighed = asked.join(holders, "term").select("row", "item", F.struct("term", weight.alias("weight")).alias("t"))
    rows = weighed.groupBy("row", "item").agg(F.array_sort(F.collect_list("t")).alias("t")).select("item", "row", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    pairs = tile_pairs(_query_blocks(rows), impact_blocks(counted, n_docs, max(1, n_terms)), ordered=False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bars = None, {}
        for row in (r for batch in batches for n in range(batch.num_rows) for r in batch.slice(n, 1).to_pylist()):  # one block at a time
            if row["a"] != of:
                of, bars = row["a"], {}
                starts, terms, weights, numbers = _unpacked(row["data_a"], 4)
                numbers = numbers.tolist()
            block, found = ImpactBlock(np.frombuffer(row["ids_b"], "<i8"), row["data_b"]), []
            for j, item in enumerate(np.frombuffer(row["ids_a"], "<i8").tolist()):
                part = slice(starts[j], starts[j + 1])
                held, bar = bars.get(j, ([], 0))
                hits, _ = block.best(terms[part], weights[part], k, bar)
                found += [(item, numbers[j], score, doc) for score, doc in hits]
                held = sorted([*held, *(score for score, _ in hits)], reverse=True)[:k]
                bars[j] = held, held[-1] if len(held) == k else 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "row", "score", "doc"])

    found = pairs.sortWithinPartitions("a").mapInArrow(search, "item long, row long, score long, doc long")
    by_score = Window.partitionBy("item", "row").orderBy(F.desc("score"), F.asc("doc"))
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
