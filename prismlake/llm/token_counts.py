"""Token counts: lengths only, in Arrow batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import byte_batches, worker_encoder


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Whole texts are counted with the tokenizers library and no added special tokens. Texts are cut
    at boundaries no token spans, grouped in batches of about equal size, and only lengths leave
    the Python worker. Null and empty texts count 0 bytes and 0 tokens; a null id is carried as
    null; repeated rows give repeated results; other columns are ignored, whatever their names.
    """
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        for batch in batches:
            counts = [encoder.counts(part) for part in byte_batches(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(lengths, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
