"""MinHash near-duplicates: banded one-permutation signatures, star candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components
from .shingles import band_hashes, set_key, shingle_set

#: Link at 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
#: Shingles in a block of one bucket; blocks of this size are compared two by two.
BLOCK_SHINGLES = 1 << 19


def _signatures(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                bands.append(band_hashes(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(sign, "id long, n_shingles long, set_key binary, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets are alike enough; exact."""
    right = pairs.join(texts.select(F.col("id").alias("v"), F.col("body").alias("body_v")), "v")
    both = right.join(texts.select(F.col("id").alias("u"), F.col("body").alias("body_u")), "u").select("u", "v", "body_u", "body_v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = object(), np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = a.as_py(), b.as_py()
                if a != held_text:
                    held_text, held = a, shingle_set(a)
                other = shingle_set(b)
                common = len(np.intersect1d(held, other, assume_unique=True))
                good.append(100 * common >= percent * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(confirm, "u long, v long").distinct()


def _block_rows(open_rows: DataFrame, percent: int) -> DataFrame:
    """Rows (part, side, rep, root): each open row in all the block pairs that may hold a partner of it.

    Sets of one bucket fall in classes by size, so wide that only equal and neighbouring classes can
    hold pairs alike enough, and each class in blocks by hash.
    """
    classed = open_rows.withColumn("class", F.floor(F.log("n") / F.log(F.lit(max(100.0 / percent, 1.01))) + 1e-9).cast("int"))
    per_class = classed.groupBy("bucket", "class").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    layout = per_class.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("layout"))
    placed = classed.join(layout, "bucket").withColumn("block", F.pmod(F.xxhash64("rep", "n"), F.expr("layout[class]")).cast("int"))
    targets = F.expr("""concat(
        transform(sequence(0, layout[class] - 1), j -> named_struct('kind', 0, 'class', class, 'i', least(block, j), 'j', greatest(block, j), 'side', if(block <= j, 0, 1))),
        if(layout[class + 1] is null, array(), transform(sequence(0, layout[class + 1] - 1), j -> named_struct('kind', 1, 'class', class, 'i', block, 'j', j, 'side', 0))),
        if(layout[class - 1] is null, array(), transform(sequence(0, layout[class - 1] - 1), j -> named_struct('kind', 1, 'class', class - 1, 'i', j, 'j', block, 'side', 1))))""")
    spread = placed.select("bucket", "rep", "root", F.explode(targets).alias("t"))
    return spread.select(F.xxhash64("bucket", "t.kind", "t.class", "t.i", "t.j").alias("part"), F.col("t.side").alias("side"), "rep", "root")


def _linked_in_blocks(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different roots within each block pair whose whole shingle sets are alike enough; exact."""

    def links_of(held: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        held.sort(key=lambda r: r[0])
        sides, ids, roots = (np.array([r[k] for r in held]) for k in range(3))
        if len(held) < 2 or (roots == roots[0]).all():
            return
        sizes = np.array([len(r[3]) for r in held])
        ends = np.cumsum(sizes)
        vocabulary, codes = np.unique(np.concatenate([r[3] for r in held]), return_inverse=True)
        marked = np.zeros(len(vocabulary), bool)
        first_right = int(np.searchsorted(sides, 1))
        two_sided = first_right < len(held)
        for a in range(first_right if two_sided else len(held) - 1):
            start = first_right if two_sided else a + 1
            right = sizes[start:]
            wanted = (roots[start:] != roots[a]) & (ids[start:] != ids[a]) & (100 * right >= percent * sizes[a]) & (100 * sizes[a] >= percent * right)
            if not wanted.any():
                continue
            own = codes[ends[a] - sizes[a] : ends[a]]
            marked[own] = True
            begin = ends[start] - sizes[start]
            common = np.add.reduceat(marked[codes[begin:]], ends[start:] - right - begin, dtype=np.int64)
            marked[own] = False
            for k in np.flatnonzero(wanted & (100 * common >= percent * (sizes[a] + right - common))):
                u, v = int(ids[a]), int(ids[start + k])
                yield min(u, v), max(u, v)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, now = ["u", "v"], [], None

        def found() -> pa.RecordBatch:
            pairs = list(links_of(held))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=names)

        for batch in batches:
            for part, side, rep, root, text in zip(*batch.columns):
                if (part := part.as_py()) != now:
                    if held:
                        yield found()
                    held, now = [], part
                if len(shingles := shingle_set(text.as_py())):
                    held.append((side.as_py(), rep.as_py(), root.as_py(), shingles))
        if held:
            yield found()

    bodies = rows.join(texts.withColumnRenamed("id", "rep"), "rep").select("part", "side", "rep", "root", "body")
    return bodies.repartition("part").sortWithinPartitions("part").mapInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents whose 5-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more are
    linked; a component is named by its smallest id, and only that document is kept.

    1. Equal sets are folded to their smallest id, so copies never meet in a bucket.
    2. Sets that share a band fall in one bucket, whose smallest id is its centre. Each set is
       compared with the centres of its buckets: a star, one edge a member.
    3. A bucket whose members are all in one component is done. In the others the members of
       different components are compared on their full sets, block by block, in tasks that hold two
       blocks each; buckets with the same members count once. So every pair of sets that shares a
       band is compared or already connected, and buckets of copies cost one edge a member. A bucket
       of sets that share a band but are not alike is the costly case: its work grows with the
       square of its members, in tasks of bounded size.

    Every link is confirmed on the full sets. A pair at the threshold shares no band with a chance
    of about 1e-6. Null and empty texts have no shingles and stand alone, as do null ids
    (component_id null, kept). Rows that repeat an id are one document, joined whatever their
    texts. Extra columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    signed = stored(_signatures(base), "minhash-signatures")
    usable = signed.filter("id is not null and set_key is not null")
    folded = usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.first("n_shingles").alias("n"))
    banded = stored(folded.select("rep", "n", F.explode("bands").alias("bucket")), "minhash-bands")
    centres = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("centre"), F.count("*").alias("members")).filter("members > 1").drop("members")
    members = stored(banded.join(centres, "bucket"), "minhash-members")
    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = stored(base.filter("id is not null").join(wanted, "id", "left_semi").distinct(), "minhash-texts")

    alike = (100 * F.col("n") >= percent * F.col("centre.n")) & (100 * F.col("centre.n") >= percent * F.col("n"))
    stars = members.filter((F.col("rep") != F.col("centre.rep")) & alike).select(F.col("centre.rep").alias("u"), F.col("rep").alias("v")).distinct()
    links = stored(_confirmed(stars, texts, percent), "minhash-links")

    roots = components(links)
    rest = members.filter((F.col("rep") != F.col("centre.rep")) | (F.col("n") != F.col("centre.n"))).select("bucket", "rep", "n")
    placed = rest.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root"))
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("rep", "n").cast("decimal(38,0)")), F.sum(F.xxhash64("n", "rep").cast("decimal(38,0)")))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), print_of.alias("print")).filter("least <> most")
    chosen = mixed.groupBy("print").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_rows = stored(placed.join(chosen, "bucket"), "minhash-open")
    links = links.unionByName(stored(_linked_in_blocks(_block_rows(open_rows, percent), texts, percent), "minhash-links"))

    # copies of a set: stored, so that the join has an exchange on either side and a set that very many documents share is split
    same_set = stored(usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("set_key", "rep"), "minhash-copies")
    own = usable.select("id", "set_key").join(same_set, "set_key").filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    final = stored(components(links.unionByName(own)), "minhash-components")
    named = signed.join(final.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
