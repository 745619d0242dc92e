"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ngrams import gram_slots

SIZES = (3, 4, 5)
BITS = 20
#: At most about this many labelled rows are learned from, drawn by a hash of the id.
SAMPLE_ROWS = 8000
#: Features kept: those whose share of texts differs between the labels by so many standard errors.
LEAST_Z = 4.5
#: Of few labelled texts no feature may reach that, so at least so many are kept, the strongest.
LEAST_FEATURES = 200
RIDGE = 0.5


@dataclass
class ToxicityModel:
    place: np.ndarray  # feature number of a slot, -1 for none
    weight: np.ndarray  # by feature, the log-count ratio folded in
    bias: float


def _features(text: str) -> np.ndarray:
    return np.unique(gram_slots(text.lower(), SIZES, BITS))


def _logistic(ends: np.ndarray, places: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge weights and a free bias by a few Newton steps, each solved by conjugate gradients.

    Row k of the sparse matrix holds ``scale`` at ``places[ends[k] : ends[k + 1]]``. A step is halved
    until it lowers the loss, which is convex, so no step can lead away. The steps end when they no
    longer move the log odds of any row.
    """
    row, value, m = np.repeat(np.arange(len(y)), np.diff(ends)), scale[places], len(scale)
    penalty = np.r_[np.full(m, ridge), 1e-6]

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[places], len(y)) + w[m]

    def back(g: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(places, value * g[row], m), g.sum()]

    def loss(w: np.ndarray) -> float:
        odds = times(w)
        return float((np.logaddexp(0, odds) - y * odds).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(m + 1)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(times(w), -35, 35)))
        curve = np.maximum(p * (1 - p), 1e-9)
        gradient = back(p - y) + penalty * w
        diagonal = np.r_[np.bincount(places, value**2 * curve[row], m), curve.sum()] + penalty
        step, left = np.zeros(m + 1), -gradient
        along = left / diagonal
        size = left @ along
        for _ in range(15):
            turned = back(curve * times(along)) + penalty * along
            length = size / max(along @ turned, 1e-300)
            step, left = step + length * along, left - length * turned
            before, size = size, left @ (left / diagonal)
            if size <= 1e-6 * (gradient @ (gradient / diagonal)):
                break
            along = left / diagonal + size / before * along
        now, part, slope = loss(w), 1.0, float(gradient @ step)
        while loss(w + part * step) > now + 1e-4 * part * slope and part > 1e-6:
            part /= 2
        w += part * step
        if np.abs(times(part * step)).max() < 1e-2:
            break
    return w[:m], float(w[m])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the texts that ``labels`` (id, label) marks 0 or 1; ``sample_rows`` bounds the fit.

    The sample is drawn from distinct (id, label) pairs by a hash of the id, about ``sample_rows`` of
    them, so it is small enough to broadcast and only its texts are read further. Features are the
    distinct hashed n-grams of a text. Those whose share of texts differs between the labels by less
    than ``LEAST_Z`` standard errors, or that fewer than 3 texts hold, are left out, but not the
    ``LEAST_FEATURES`` strongest of those that 3 texts hold; all others, at most 2**BITS, are scaled by their naive Bayes log-count ratio, and a ridge logistic regression weighs them.
    Null ids, texts and labels are not learned from. With no rows, or one label only, the score is
    the share of label 1 for every text.
    """
    pairs = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    total = pairs.count()
    if total > sample_rows:
        draw = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 24))
        pairs = pairs.filter(draw < int((1 << 24) * sample_rows / total))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    rows = texts.join(F.broadcast(pairs), F.col("id") == F.col("_id")).select("body", "label")

    sample = stored(rows.repartition(4), "toxicity-sample")
    of_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of_label.get(1, 0), of_label.get(0, 0)
    place = np.full(1 << BITS, -1, np.int32)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return ToxicityModel(place, np.zeros(0), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_label = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                with_label[label][_features(text.as_py())] += 1
        used = np.flatnonzero(with_label.any(0))
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(with_label[1][part]), pa.array(with_label[0][part])], names=["slot", "with_1", "with_0"])

    # documents that hold a slot, by label; only the telling slots leave Spark
    held = stored(sample.mapInArrow(count, "slot int, with_1 int, with_0 int").groupBy("slot").agg(F.sum("with_1").alias("with_1"), F.sum("with_0").alias("with_0")), "toxicity-counts")
    all_1, all_0 = held.agg(F.sum("with_1"), F.sum("with_0")).first()
    pooled = (F.col("with_1") + F.col("with_0")) / float(n1 + n0)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    z = F.abs(F.col("with_1") / n1 - F.col("with_0") / n0) / error
    common = held.withColumn("z", z).filter(F.col("with_1") + F.col("with_0") >= 3)
    strongest = common.orderBy(F.desc("z"), "slot").limit(LEAST_FEATURES)
    chosen = common.filter(F.col("z") >= LEAST_Z).union(strongest).distinct().toPandas().sort_values("slot")
    place[chosen["slot"].to_numpy()] = np.arange(len(chosen))
    ratio = np.log((chosen["with_1"].to_numpy() + 1.0) / (all_1 + 1)) - np.log((chosen["with_0"].to_numpy() + 1.0) / (all_0 + 1))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                at = shared.value[gram_slots(text.as_py().lower(), SIZES, BITS)]
                found.append(np.unique(at[at >= 0]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["held", "label"])

    matrix = sample.mapInArrow(extract, "held array<int>, label int").toArrow()
    held, ends = matrix["held"].combine_chunks(), np.cumsum([0, *pc.list_value_length(matrix["held"]).to_pylist()])
    weight, bias = _logistic(ends, held.flatten().to_numpy(), ratio, matrix["label"].to_numpy().astype(np.float64), RIDGE)
    return ToxicityModel(place, weight * ratio, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, 0 to 1, of the whole text, of any length.

    Null and empty texts score as no features do; repeated rows score alike; all columns are kept,
    except that one named ``score_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores = []
            for value in batch.column(text_at):
                at = known.place[gram_slots((value.as_py() or "").lower(), SIZES, BITS)]
                at = np.unique(at[at >= 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(known.weight[at].sum() + known.bias, -35, 35)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_score"])

    text_at = docs.columns.index(text_col)
    kept = ", ".join(f"`_{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    slim = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)])
    out = slim.mapInArrow(score, f"{kept}{', ' if kept else ''}_score double")
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() != score_col.lower()], F.col("_score").alias(score_col))
