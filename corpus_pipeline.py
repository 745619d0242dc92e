"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.bpe import bpe_digests
from prismlake.llm.common import free_name, id_remainder, row_hash, stored, table, text_batches
from prismlake.llm.langid import UNKNOWN, fit_languages, predict_languages
from prismlake.llm.minhash import near_duplicates
from prismlake.llm.mixing import emit, mix
from prismlake.llm.queries import tokenizer
from prismlake.llm.toxicity import fit_toxicity, score_toxicity

#: A document goes at this toxicity score.
TOXIC_AT = 0.7
#: A document stays if its language has at least this share of the posterior: more than all others together.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_AT``.

    Every row is scored on its whole text; repeated rows go or stay together, null and empty texts
    score as no features do, null ids are scored but not learned from. Without rows, or without
    labels of both kinds, the score is the same for all. Other columns are kept, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(F.coalesce(id_remainder("doc_id", 3) != 1, F.lit(False)))
    text_batches(spark)
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    score = free_name(docs.columns, "toxicity")
    return score_toxicity(docs, model, score_col=score).filter(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: those predicted as ``und``, or with a posterior below ``LEAST_LANGUAGE_SCORE``, go.

    So null texts and those without a letter go, texts that no learned language explains better than all
    others together, and all if no language was learned. Repeated rows go or stay together; texts of
    any length count whole; null ids are judged but not learned from; other columns are kept, whatever
    their names.
    """
    text_batches(spark)
    learned = docs.filter(F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False)))
    lang = free_name(docs.columns, "predicted_language")
    score = free_name([*docs.columns, lang], "language_score")
    predicted = predict_languages(docs, fit_languages(learned), pred_col=lang, score_col=score)
    return predicted.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, once.

    Rows that repeat an id are one document; of them the row with the least hash stays, so reruns
    agree. Null ids, and null and empty texts, are alike to nothing and stay. Other columns are
    kept, whatever their names.
    """
    text_batches(spark)
    draw = free_name(docs.columns, "draw")
    rows = docs.withColumn(draw, row_hash(docs))
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    chosen = rows.groupBy("doc_id").agg(F.min(draw).alias(draw)).join(kept, "doc_id")
    left = rows.join(chosen, ["doc_id", draw], "left_semi").dropDuplicates(["doc_id", draw])
    return left.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Ties in size go by id; rows alike in id, text and source share what they are taken together.
    Other columns are kept, whatever their names.
    """
    return emit(docs, mix(docs)).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, ids digest and decoded digest of each row; repeated rows give repeated results, null texts count as empty."""
    import public_tokenizers

    text_batches(spark)
    return bpe_digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", encode_and_decode),
]

#: The trained classifiers and the MinHash groups are beyond SQL; tests/llm/test_pipeline.py holds run() and each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
