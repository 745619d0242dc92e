"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ngrams import batch_slots
from .pieces import byte_batches

SIZES = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
#: Languages of one broadcast: 64 MB of log probabilities. More languages come in several.
BLOCK_LANGUAGES = 512
#: A task that has counted so many languages passes its counts on and starts again.
HELD_LANGUAGES = 128
UNKNOWN = "und"


@dataclass
class LanguageBlock:
    languages: list[str]
    prior: np.ndarray  # log, by language
    weight: np.ndarray  # log probability, slot by language


@dataclass
class LanguageModel:
    blocks: list[Broadcast]  # of LanguageBlock, in the order of the names


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count n-grams by language over all rows with a text and a language.

    Each task counts its own rows into one dense table a language and emits the slots it has seen;
    Spark sums them and stores the sums. The driver then takes ``BLOCK_LANGUAGES`` languages at a time, at
    most 2**BITS numbers for each, and broadcasts their matrix. No rows give a model without
    languages; a repeated row counts each time; whole texts count, of any length.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, counts in tables.items():
                used = np.flatnonzero(counts)
                slot, n = np.r_[-1, used].astype(np.int32), np.r_[seen[lang], counts[used]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot)), pa.array(slot), pa.array(n)], names=["lang", "slot", "n"])

        for batch in batches:
            at = 0
            for part in byte_batches(batch.column(0)):
                langs = batch.column(1).slice(at, len(part)).to_pylist()
                at += len(part)
                texts = [text.as_py().lower() for text in part]
                names = sorted(set(langs))
                place = {lang: k for k, lang in enumerate(names)}
                for first in range(0, len(names), HELD_LANGUAGES):
                    mine = [k for k, lang in enumerate(langs) if first <= place[lang] < first + HELD_LANGUAGES]
                    own = np.array([place[langs[k]] - first for k in mine])
                    here = np.zeros((min(HELD_LANGUAGES, len(names) - first), 1 << BITS), np.int64)
                    for row, slots in batch_slots([texts[k] for k in mine], SIZES, BITS):
                        here += np.bincount(own[row] << BITS | slots, minlength=here.size).reshape(here.shape)
                    for k, lang in enumerate(names[first : first + HELD_LANGUAGES]):
                        tables[lang] = tables.get(lang, 0) + here[k]
                        seen[lang] = seen.get(lang, 0) + langs.count(lang)
                if len(tables) > HELD_LANGUAGES:
                    yield from counted()
                    tables, seen = {}, {}
        yield from counted()

    summed = stored(rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "language-counts")
    docs_of = {r["lang"]: r["n"] for r in summed.filter("slot < 0").select("lang", "n").collect()}
    languages, total, blocks = sorted(docs_of), sum(docs_of.values()), []
    for at in range(0, len(languages), BLOCK_LANGUAGES):
        names = languages[at : at + BLOCK_LANGUAGES]
        found = summed.filter((F.col("slot") >= 0) & (F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).toPandas()
        counts = np.zeros((1 << BITS, len(names)))
        counts[found["slot"].to_numpy(), found["lang"].map({lang: k for k, lang in enumerate(names)}).to_numpy(np.int64)] = found["n"].to_numpy()
        weight = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * (1 << BITS))
        prior = np.log(np.array([docs_of[lang] for lang in names]) / total)
        blocks.append(docs.sparkSession.sparkContext.broadcast(LanguageBlock(names, prior, weight.astype(np.float32))))
    return LanguageModel(blocks)


def log_posteriors(texts: list[str], block: LanguageBlock) -> np.ndarray:
    """Log prior plus log likelihood, text by language: the sparse counts of a batch times the matrix."""
    total = np.tile(block.prior, (len(texts), 1))
    for row, slots in batch_slots([text.lower() for text in texts], SIZES, BITS):
        for k in range(len(block.languages)):
            total[:, k] += np.bincount(row, block.weight[:, k][slots], len(texts))
    return total


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col``, the posterior of the prediction.

    Null texts, texts without a letter, and any text under a model without languages get ``und``
    and score 0. Every n-gram of the whole text counts, of whatever length. A tie goes to the smaller
    name; repeated rows get the same answer each. All columns of ``docs`` are kept, except that
    columns named ``pred_col`` or ``score_col`` are replaced.
    """
    width, text_at = len(docs.columns), docs.columns.index(text_col)
    slim = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)], F.lit(UNKNOWN).alias("_lang_pred"), F.lit(None).cast("double").alias("_best"), F.lit(0.0).alias("_mass"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)

    def classify(shared: Broadcast):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                names, best, mass = (batch.column(width + k).to_pylist() for k in range(3))
                at = 0
                for part in byte_batches(batch.column(text_at)):
                    texts = [(at + k, text) for k, text in enumerate(part.to_pylist()) if text is not None and has_letter(text)]
                    at += len(part)
                    if not texts:
                        continue
                    total = log_posteriors([text for _, text in texts], block)
                    tops = total.argmax(1)
                    for (k, _), top, row in zip(texts, tops.tolist(), total):
                        # mass: what all languages so far weigh, beside the best of them
                        most, before = float(row[top]), best[k]
                        if before is None or most > before:
                            mass[k] = (0.0 if before is None else mass[k] * float(np.exp(before - most))) + float(np.exp(row - most).sum())
                            names[k], best[k] = block.languages[top], most
                        else:
                            mass[k] += float(np.exp(row - before).sum())
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(mass, pa.float64())], names=batch.schema.names)

        return of

    for shared in model.blocks:
        slim = slim.mapInArrow(classify(shared), fields)
    score = F.when(F.col("_mass") > 0, 1 / F.col("_mass")).otherwise(F.lit(0.0))
    kept = [F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in (pred_col.lower(), score_col.lower())]
    return slim.select(*kept, F.col("_lang_pred").alias(pred_col), score.alias(score_col))
