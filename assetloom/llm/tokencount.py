"""Operator 5: token counts, by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import byte_slices, flat_bytes, table

#: Characters above which a text is split at safe boundaries, and bytes of text in an encoder batch.
PART_CHARS, BATCH_BYTES = 1 << 16, 1 << 20


def token_counts(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = tokens.DEFAULT, limit: int = 1024) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty text: 0 bytes, 0 tokens. Repeated rows each give a row; a null id stays
    null; other columns are not read. The texts go to the library in batches of about
    BATCH_BYTES, long ones split where the pre-tokeniser must break (for sentencepiece files
    they are not: their pieces may cross spaces); only lengths leave a task.
    """
    splits = not vocabulary.endswith(".model")

    def count(batches):
        enc = tokens.encoder(vocabulary)
        for batch in batches:
            for part in byte_slices(batch, "text", BATCH_BYTES):
                _, offsets = flat_bytes(part.column("text"))
                n = np.zeros(part.num_rows, np.int64)
                texts, owner, size = [], [], 0
                for i, text in enumerate(part.column("text").to_pylist()):
                    for piece in tokens.safe_parts(text, PART_CHARS) if splits and text else [text or ""]:
                        texts.append(piece)
                        owner.append(i)
                        size += len(piece)
                        if size >= BATCH_BYTES:  # a long document makes several batches
                            np.add.at(n, owner, enc.counts(texts))
                            texts, owner, size = [], [], 0
                if texts:
                    np.add.at(n, owner, enc.counts(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
