"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components
from .tiles import is_usable, packed, tile_pairs

TILE_ROWS = 2048


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers -127..127, step, norm of the rounding error) of each unit vector.

    With x = step * q + e, a product x.y differs from step_x * step_y * (q_x.q_y) by
    e_x.(y - e_y) + x.e_y, at most |e_x| * (1 + |e_y|) + |e_y| in absolute value (norms of 1).
    """
    step = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    q = np.rint(unit / step[:, None])
    error = np.sqrt(((unit - q * step[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.int8), step, error


def scaled(v: np.ndarray) -> np.ndarray:
    """The vectors by their largest component, a power of two, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


#: What a comparison finds: an edge (u, v), or a node's links (u, others), or a pair of tiles with the nodes and the marks of its doubtful pairs.
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("others", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("nodes_a", pa.list_(pa.int64())), ("nodes_b", pa.list_(pa.int64())), ("marks", pa.binary())])
_FOUND_SQL = "u long, v long, others long, a long, b long, nodes_a array<long>, nodes_b array<long>, marks binary"


def _found(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(field.name, pa.nulls(n, field.type)) for field in _FOUND], schema=_FOUND)


def _light(data: np.ndarray) -> bytes:
    """A tile's unit vectors as whole numbers, with the step, the norm of the error and the copies of each."""
    v, copies = data[:, :-1], data[:, -1]
    v = scaled(v)
    q, step, error = quantised(v / np.sqrt((v * v).sum(1))[:, None])
    return np.concatenate([step, error, copies]).astype("<f8").tobytes() + q.tobytes()


def _parts(data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (24 + dims)
    step, error, copies = np.frombuffer(data, "<f8", 3 * n).reshape(3, n)
    return np.frombuffer(data, np.int8, n * dims, 24 * n).reshape(n, dims), step, error, copies


def bounded_mask(qa: np.ndarray, step_a: np.ndarray, err_a: np.ndarray, qb: np.ndarray, step_b: np.ndarray, err_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(surely linked, doubtful) pairs by the product of the whole numbers and its error bound."""
    # whole numbers: exact in single precision while dims * 127**2 < 2**24
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T) * (step_a[:, None] * step_b[None, :])
    bound = err_a[:, None] * (1 + err_b[None, :]) + err_b[None, :] + 1e-9
    sure = near - bound >= threshold + 1e-9
    return sure, (near + bound >= threshold) & ~sure


def exact_mask(a: np.ndarray, b: np.ndarray, doubtful: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ``doubtful`` pairs have a cosine of at least ``threshold``, in double precision."""
    a, b = scaled(a), scaled(b)
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    mask = np.zeros(doubtful.shape, bool)
    i, j = np.nonzero(doubtful)
    for at in range(0, len(i), 1 << 16):
        k, m = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        mask[k, m] = (a[k] * b[m]).sum(1) / (norm_a[k] * norm_b[m]) >= threshold
    return mask


def linked_mask(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``threshold``, in double precision."""
    a, b = scaled(a), scaled(b)
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    unit_a, unit_b = a / norm_a[:, None], b / norm_b[:, None]
    mask, doubtful = bounded_mask(*quantised(unit_a), *quantised(unit_b), threshold)
    return mask | exact_mask(a, b, doubtful, threshold)


def _forest(mask: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``mask`` joins, at most one a row and one a column."""
    label_a = np.where(mask.any(1), np.arange(len(ids_a)), -1)
    big = np.int64(1 << 60)
    root_a, root_b = label_a.astype(np.int64), np.full(len(ids_b), big)
    while True:
        root_b2 = np.where(mask, root_a[:, None], big).min(0, initial=big)
        root_a2 = np.where(label_a >= 0, np.minimum(root_a, np.where(mask, root_b2[None, :], big).min(1, initial=big)), -1)
        if (root_a2 == root_a).all() and (root_b2 == root_b).all():
            break
        root_a, root_b = root_a2, root_b2
    rows, columns = np.flatnonzero(label_a >= 0), np.flatnonzero(root_b < big)
    return np.r_[ids_a[rows], ids_b[columns]], np.r_[ids_a[root_a[rows]], ids_a[root_b[columns]]]


def _links(mask: np.ndarray, same: bool, ids: tuple, copies: tuple) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the marked pairs, and the links of each node by copies."""
    if not mask.any():
        return
    u, v = _forest(mask, *ids)
    yield _found(len(u), u=pa.array(u), v=pa.array(v))
    of, others = ids[0], mask @ copies[1]
    if not same:
        of, others = np.r_[ids[0], ids[1]], np.r_[others, copies[0] @ mask]
    some = others > 0
    yield _found(int(some.sum()), u=pa.array(of[some]), others=pa.array(others[some].astype(np.int64)))


def _doubts(row: dict, doubtful: np.ndarray, ids: tuple) -> pa.RecordBatch:
    """The rows and columns that hold a doubtful pair, and which pairs of these are doubtful."""
    rows, columns = np.flatnonzero(doubtful.any(1)), np.flatnonzero(doubtful.any(0))
    marks = np.packbits(doubtful[np.ix_(rows, columns)]).tobytes()
    nodes = [pa.array([of[at].tolist()], pa.list_(pa.int64())) for of, at in ((ids[0], rows), (ids[1], columns))]
    return _found(1, a=pa.array([row["a"]]), b=pa.array([row["b"]]), nodes_a=nodes[0], nodes_b=nodes[1], marks=pa.array([marks]))


def _settle(threshold: float):
    """The links among the doubtful pairs of one pair of tiles, by the doubles of the rows they name."""

    def settle(marks: pa.Table, rows: pa.Table) -> pa.Table:
        same = marks.column("a")[0] == marks.column("b")[0]
        sides = []
        for side in (0, 1):
            of = rows.filter(pc.equal(rows.column("side"), side)).sort_by("place").combine_chunks()
            v = pc.list_flatten(of.column("v")).to_numpy().reshape(of.num_rows, -1)
            sides.append((of.column("node").to_numpy(), of.column("copies").to_numpy().astype(float), v))
        (ids_a, copies_a, a), (ids_b, copies_b, b) = sides
        bits = np.frombuffer(marks.column("marks")[0].as_py(), np.uint8)
        doubtful = np.unpackbits(bits, count=len(ids_a) * len(ids_b)).reshape(len(ids_a), len(ids_b)).astype(bool)
        return pa.Table.from_batches(_links(exact_mask(a, b, doubtful, threshold), same, (ids_a, ids_b), (copies_a, copies_b)), _FOUND)

    return settle


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are folded first, so copies cost nothing and count by their number. The others
    are packed in tiles of int8 numbers with a step and an error norm each; each pair of tiles is one
    product of these. A pair within its error bound of the threshold is in doubt: the two vectors, and no
    others of their tiles, are fetched in double precision, and just such pairs are computed anew. A task returns link
    counts and a spanning forest of its links, at most a few rows a vector, never all links. Vectors of unlike
    length do not link. Vectors that are null, zero, or hold null or non-finite components have no
    links and their own id as component; a null id takes no part (component_id null, kept). Rows
    that repeat an id are one node: their links and copies are summed. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    fine = rows.filter(F.col("id").isNotNull() & is_usable("v") & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are equal as numbers: folded alike
    keyed = fine.select("id", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v")).withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    members = stored(keyed.groupBy("key", "id").agg(F.count("*").alias("n"), F.first("v").alias("v")), "embedding-members")
    # numbered as they are written, so that the numbers are unique and stay
    numbered = stored(members.groupBy("key").agg(F.min("id").alias("rep"), F.sum("n").alias("copies"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "embedding-folded")
    tiles = packed(numbered.select("node", F.concat("v", F.array(F.col("copies").cast("double")))), tile_rows, "embedding-tiles", data=_light)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same, dims = row["a"] == row["b"], row["dims"] - 1
                ids = tuple(np.frombuffer(row[c], "<i8") for c in ("ids_a", "ids_b"))
                (qa, step_a, err_a, copies_a), (qb, step_b, err_b, copies_b) = (_parts(row[c], dims) for c in ("data_a", "data_b"))
                sure, doubtful = bounded_mask(qa, step_a, err_a, qb, step_b, err_b, threshold)
                if same:
                    np.fill_diagonal(sure, False)
                    np.fill_diagonal(doubtful, False)
                yield from _links(sure, same, ids, (copies_a, copies_b))
                if doubtful.any():
                    yield _doubts(row, doubtful, ids)

    first = stored(tile_pairs(tiles, tiles, ordered=True).mapInArrow(compare, _FOUND_SQL), "embedding-links")
    doubts = first.filter("marks is not null")
    wanted = [doubts.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), F.lit(side).alias("side"), F.posexplode(nodes).alias("place", "node")) for side, nodes in enumerate(("nodes_a", "nodes_b"))]
    fetched = wanted[0].unionByName(wanted[1]).join(numbered.select("node", "copies", "v"), "node")
    marks = doubts.select("a", "b", "marks")
    second = stored(marks.groupBy("a", "b").cogroup(fetched.groupBy("of_a", "of_b")).applyInArrow(_settle(threshold), _FOUND_SQL), "embedding-links")
    found = first.filter("marks is null").unionByName(second)
    linked = found.filter("others is not null").groupBy("u").agg(F.sum("others").alias("others"))
    names = numbered.select("node", "rep")
    forest = found.filter("v is not null").join(names.select(F.col("node").alias("u"), F.col("rep").alias("ru")), "u").join(names.select(F.col("node").alias("v"), F.col("rep").alias("rv")), "v")
    own = members.select("key", "id", "n").join(numbered.select("key", "node", "rep", "copies"), "key").join(linked.withColumnRenamed("u", "node"), "node", "left")
    counted = stored(own.groupBy("id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min("rep").alias("rep")), "embedding-counts")
    edges = forest.select(F.col("ru").alias("u"), F.col("rv").alias("v")).unionByName(own.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    roots = stored(components(edges), "embedding-roots")
    out = rows.select("id").join(counted.select("id", "n_links"), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    named = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
