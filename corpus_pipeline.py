"""A corpus from raw documents to token files: each stage reads what the one before has written.

Defined results: columns of ``documents`` keep any name, also those of the operators' own measures;
null and empty texts fail the quality rules and go, a null id or source stays; of rows equal in id and
text near-dedup keeps one; an empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import decontaminate, mixing, near_duplicates, quality_ledger, token_files
from tabloom.llm.common import scratch_folder, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects. The ledger sees the row as one column and the text,
    so that its measures replace no column of the documents."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return quality_ledger.ledger(docs.select(row, "text")).filter(quality_ledger.passes("v2")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return near_duplicates.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; equal texts go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, a row with the whole document for each time it is used, in training order."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in training order, the order in which the mixture was written, and what they hold."""
    import public_tokenizers

    folder = scratch_folder(spark, "pipeline-tokens")
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    manifest = token_files.write_files(docs, folder, public_tokenizers.path(token_files.TOKENIZER), order=order)
    return token_files.read_files(manifest, folder)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixture", mixture),
    ("token files", token_output),
]
#: The tokenizer's ids and the links of similar documents have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
