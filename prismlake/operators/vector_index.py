"""Exact nearest vectors by cosine through inverted lists: lists that cannot hold a better one are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalize
from ..scratch import stored
from .blocks import is_usable, tile_pairs
from .embeddings import nearest

#: Centres of the lists, vectors they are fitted on, and vectors of a block.
CENTRES, SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS = 256, 20_000, 1024, 128
#: What rounding may take from an angle.
MARGIN = 1e-6


def fit_centres(vectors: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors: k-means by cosine, from a start that spreads over the sample."""
    rng = np.random.default_rng(7)
    vectors = vectors[np.abs(vectors).sum(1) > 0]
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    at = vectors[rng.choice(len(vectors), min(centres, len(vectors)), replace=False)]
    for _ in range(rounds):
        own = (vectors @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1)
        at = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], at)
    return at


def _assigned(centres: Broadcast):
    """(id, v, dims, list, angle): the nearest centre of each unit vector and the angle to it; -1 for zero vectors and lengths without centres."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values, np.float64) for v in batch.column(1)]
            lists, angles = [], []
            for v in vectors:
                known = centres.value.get(len(v))
                if known is None or not len(known) or not v.any():
                    lists.append(-1)
                    angles.append(0.0)
                    continue
                cosine = known @ v
                lists.append(int(cosine.argmax()))
                angles.append(float(np.arccos(np.clip(cosine.max(), -1, 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, vectors), pa.int32()), pa.array(lists, pa.int32()), pa.array(angles, pa.float64())], names=["id", "v", "dims", "list", "angle"])

    return assign


def _list_blocks(assigned: DataFrame, rows: int, label: str) -> DataFrame:
    """(tile, dims, list, low, high, n, ids, data): vectors of one list and length, up to ``rows`` a row, in order of their angle.

    A list that fills many tasks is cut over them by the angle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made, held, now, kind = context.partitionId() if context else 0, 0, [], None, pa.null()

        def block() -> pa.RecordBatch:
            ids, data, angles = zip(*held)
            order = sorted(range(len(ids)), key=lambda k: ids[k])  # ties go to the smaller id
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([min(angles)]), pa.array([max(angles)]), pa.array([len(ids)], pa.int64()), pa.array([[ids[k] for k in order]], pa.list_(kind)), pa.array([np.stack([data[k] for k in order]).astype("<f8").tobytes()])],
                names=["tile", "dims", "list", "low", "high", "n", "ids", "data"],
            )

        for batch in batches:
            kind = batch.column(0).type
            dims, lists, angles = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for k, (row_id, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                if held and ((dims[k], lists[k]) != now or len(held) == rows):
                    yield block()
                    made, held = made + 1, []
                now = (dims[k], lists[k])
                held.append((row_id, np.asarray(v.values, np.float64), angles[k]))
        if held:
            yield block()

    order = ["dims", "list", "angle", "id"]
    kind = assigned.schema["id"].dataType.simpleString()
    laid = stored(assigned, f"{label}-lists").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(laid.mapInArrow(pack, f"tile long, dims int, list int, low double, high double, n long, ids array<{kind}>, data binary"), label)


def _unit(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.filter(is_usable(vector_col)).select(F.col(id_col).alias("id"), l2_normalize(F.col(vector_col)).alias("v"))


@dataclass(frozen=True)
class VectorIndex:
    """Blocks of items in inverted lists round ``centres`` (by vector length)."""

    blocks: DataFrame
    centres: Broadcast
    id_col: str

    @classmethod
    def build(cls, items: DataFrame, centres: int = CENTRES, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Index every usable vector; only the centres are fitted on a sample, of about ``sample_rows`` drawn by a hash of the id.

        What the centres are decides how much a search may skip, never what it finds.
        """
        unit = stored(_unit(items, id_col, vector_col), "index-vectors")
        total = unit.count()
        sample = unit if total <= sample_rows else unit.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / total))
        by_length: dict[int, list] = {}
        for r in sample.select("v").limit(2 * sample_rows).toLocalIterator():
            by_length.setdefault(len(r["v"]), []).append(r["v"])
        shared = items.sparkSession.sparkContext.broadcast({dims: fit_centres(np.array(v), centres) for dims, v in by_length.items()})
        kind = unit.schema["id"].dataType.simpleString()
        assigned = unit.mapInArrow(_assigned(shared), f"id {kind}, v array<double>, dims int, list int, angle double")
        return cls(_list_blocks(assigned, block_rows, "index-blocks"), shared, id_col)

    def _wanted(self, queries: DataFrame) -> DataFrame:
        """(dims, a, b, rows): which rows of which query block may find better vectors in which item block."""
        meta = self.blocks.select("tile", "dims", "list", "low", "high")
        chunk = F.pmod(F.xxhash64("tile"), F.lit(max(1, -(-meta.count() // 2048))))
        # the bounds of some 2,048 blocks a row
        packed = meta.groupBy("dims", (F.shiftleft(F.col("dims").cast("long"), 40) + chunk).alias("tile")).agg(F.collect_list(F.struct("tile", "list", "low", "high")).alias("blocks"))
        bounds = stored(packed.select("tile", "dims", F.col("blocks.tile").alias("ids"), F.to_json(F.struct(F.col("blocks.list").alias("list"), F.col("blocks.low").alias("low"), F.col("blocks.high").alias("high"))).cast("binary").alias("data")), "index-bounds")
        centres = self.centres

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import json

            for batch in batches:
                for row in batch.to_pylist():
                    q = np.frombuffer(row["data_a"], "<f8").reshape(-1, row["dims"] + 1)
                    reach, q = np.arccos(np.clip(1 - q[:, -1], -1, 1)) + MARGIN, q[:, :-1]  # the angle of the kth best so far
                    of = {k: np.asarray(v) for k, v in json.loads(row["data_b"]).items()}
                    known = centres.value.get(row["dims"])
                    least = np.full((len(q), len(of["list"])), np.pi / 2)  # zero vectors are at a right angle to all
                    real = of["list"] >= 0
                    if known is not None and len(known) and real.any():
                        to_centre = np.arccos(np.clip(q @ known[of["list"][real]].T, -1, 1))
                        least[:, real] = np.maximum(0, np.maximum(to_centre - of["high"][real], of["low"][real] - to_centre))
                    least[~q.any(1)] = np.pi / 2
                    wanted = least <= reach[:, None]
                    for n in np.flatnonzero(wanted.any(0)).tolist():
                        yield pa.RecordBatch.from_pydict({"dims": pa.array([row["dims"]], pa.int32()), "a": pa.array([row["a"]], pa.int64()), "b": pa.array([row["ids_b"][n]], pa.int64()), "rows": [np.flatnonzero(wanted[:, n]).astype("<i4").tobytes()]})

        return tile_pairs(queries, bounds, ordered=False).mapInArrow(compare, "dims int, a long, b long, rows binary")

    def search(self, queries: DataFrame, k: int, id_col: str | None = None, vector_col: str = "embedding") -> DataFrame:
        """(query_id, id, distance, rank): the ``k`` nearest items of each query, as ``cosine_topk`` gives them.

        Each query first meets one block of its nearest centre's list; the kth distance there bounds what is
        still of use. By the triangle inequality no vector of a block is nearer than the difference of
        the angles to their centre, so only blocks within that bound are read.
        """
        return self._ranked(self._pairs(queries, k, id_col or self.id_col, vector_col), k)

    def share_read(self, queries: DataFrame, k: int, id_col: str | None = None, vector_col: str = "embedding") -> float:
        """Of all pairs of a query and an item of its length, the share that a search computes."""
        own = id_col or self.id_col
        pairs = self._pairs(queries, k, own, vector_col)
        computed = pairs.agg(F.coalesce(F.sum(F.octet_length("rows") / 4 * F.size("ids_b")), F.lit(0.0))).first()[0]
        sizes = _unit(queries, own, vector_col).groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("q"))
        every = self.blocks.groupBy("dims").agg(F.sum("n").alias("n")).join(sizes, "dims").agg(F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0))).first()[0]
        return computed / max(1, every)

    def _pairs(self, queries: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
        unit = _unit(queries, id_col, vector_col)
        kind = unit.schema["id"].dataType.simpleString()
        asked = _list_blocks(unit.mapInArrow(_assigned(self.centres), f"id {kind}, v array<double>, dims int, list int, angle double"), QUERY_ROWS, "index-queries")
        seeds = self.blocks.groupBy("dims", "list").agg(F.max_by("tile", F.struct("n", "tile")).alias("b"))
        first = asked.join(seeds, ["dims", "list"], "left").select("tile", "dims", "ids", "data", "b")
        met = first.join(self.blocks.select(F.col("tile").alias("b"), F.col("data").alias("seed")), "b", "left").select("tile", "dims", F.col("ids"), "data", "seed")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Adds to each query the kth distance among its seeds; 2, the largest there is, without k of them."""
            for batch in batches:
                at = {name: n for n, name in enumerate(batch.schema.names)}
                data = []
                for n in range(batch.num_rows):
                    dims = batch.column(at["dims"])[n].as_py()
                    q, seed = np.frombuffer(batch.column(at["data"])[n].as_py(), "<f8").reshape(-1, dims), batch.column(at["seed"])[n].as_py()
                    kth = np.full(len(q), 2.0)
                    if seed is not None and len(seed) >= 8 * dims * k:
                        far = 1 - q @ np.frombuffer(seed, "<f8").reshape(-1, dims).T
                        kth = np.minimum(2.0, np.partition(far, k - 1, axis=1)[:, k - 1] + 1e-9)
                    data.append(np.c_[q, kth].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(at["tile"]), batch.column(at["dims"]), batch.column(at["ids"]), pa.array(data, pa.binary())], names=["tile", "dims", "ids", "data"])

        bounded = stored(met.mapInArrow(bound, f"tile long, dims int, ids array<{kind}>, data binary"), "index-bounded")
        wanted = stored(self._wanted(bounded), "index-wanted")
        with_a = wanted.join(bounded.select(F.col("tile").alias("a"), F.col("ids").alias("ids_a"), F.col("data").alias("data_a")), "a")
        return with_a.join(self.blocks.select(F.col("tile").alias("b"), F.col("ids").alias("ids_b"), F.col("data").alias("data_b")), "b")

    def _ranked(self, pairs: DataFrame, k: int) -> DataFrame:
        kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("ids_a", "ids_b")]

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = {name: n for n, name in enumerate(batch.schema.names)}
                for n in range(batch.num_rows):
                    of = {name: batch.column(c)[n] for name, c in at.items()}
                    dims = of["dims"].as_py()
                    rows = np.frombuffer(of["rows"].as_py(), "<i4")
                    q, v = np.frombuffer(of["data_a"].as_py(), "<f8").reshape(-1, dims + 1)[rows, :-1], np.frombuffer(of["data_b"].as_py(), "<f8").reshape(-1, dims)
                    places, distances = zip(*nearest(q, v, k))
                    whose = np.repeat(rows, [len(p) for p in places])
                    yield pa.RecordBatch.from_arrays([of["ids_a"].values.take(pa.array(whose)), of["ids_b"].values.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(distances))], names=["query_id", "id", "distance"])

        found = pairs.mapInArrow(compute, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("query_id", F.col("id").alias(self.id_col), "distance", "rank")
