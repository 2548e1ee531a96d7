"""Token counts of texts without their ids.

Pieces are counted once for each distinct word a batch of documents holds, the counts are joined
to each document's word frequencies and summed. Both sides of that join are made in the task that
reads the documents, so no word leaves its task: a global vocabulary would be shuffled at about
the size of the texts (most words of the check tables are rare), to save encoding frequent words
once a task. Word tables are bounded; a document's ids are never made.

Defined results: a null or empty text has 0 bytes and 0 tokens; null and repeated ids give a row
each; a text of any length is counted whole; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, table, text_or_empty
from tabloom.llm.wordpieces import word_pieces

TOKENIZER = "word_bpe_49k.json"


def _counted(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            for row, seen in enumerate(pieces.numbers(x.as_buffer().to_pybytes() for x in batch.column(1))):
                # distinct words of the document, their frequencies, their pieces
                words, times = np.unique(seen, return_counts=True)
                tokens[row] = int((pieces.length[words] * times).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens)], ["key", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row of ``docs``."""
    keyed = docs.select(
        F.struct(F.col(f"`{key}`").alias("key"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes")).alias("key"),
        F.encode(text_or_empty(text), "utf-8").alias("text"),
    )
    schema = f"key struct<key:{docs.schema[key].dataType.simpleString()},n_bytes:bigint>, n_tokens bigint"
    return keyed.mapInArrow(_counted(tokenizer_path), schema).select("key.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(as_long("doc_id").alias("doc_id"), "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER)).withColumnRenamed("key", "doc_id")
