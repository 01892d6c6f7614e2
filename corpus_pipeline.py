"""From raw documents to encoded training data, in five stages.

Every stage takes all that its predecessor kept, is written as Parquet in the shared folder and read again. Stages
that change a text set n_chars to its new length; all but the last return the columns of ``documents``. An empty table
passes every stage and stays empty; extra columns pass through the first four.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm import bpe, mixing, quality, simhash, suffix_merge
from lectorium.llm.common import ensure_checkpoint_dir, remove_folder, table
from lectorium.llm.queries import tokenizer_path


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    changed = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return df.select(*[changed.get(c, F.col(f"`{c}`")) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much text go whole.

    A null or empty text fails the base rules. Rows are judged one by one: a repeated or null id changes nothing.
    """
    return _with_text(quality.kept_documents(docs), docs.columns, "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts the document with the smallest id stays; 5-word shingles, similarity of 0.8 or more.

    Null, empty and blank texts are one group. Texts that share an id or have none stay if nothing links them. Of a very
    long text all shingles count.
    """
    return simhash.keep_first(docs, width=5, distance=simhash.FARTHEST, similarity=0.8)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more (about 50 words of three letters) that stand elsewhere too are cut out.

    Rows stay, whatever their ids; a document may end up empty, and a null text stays null. Very long texts are cut whole.
    """
    return _with_text(suffix_merge.remove_repeats(docs, suffix_merge.PASSAGES), docs.columns, "text")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate draws, in a global order.

    A null source is a source of its own; a row without an id is drawn by a hash of the row. Texts, however long, are not
    looked at.
    """
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with the text that they decode to; a null text has none, a very long one all of its own."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", token_ids),
]

#: SQL has no fingerprints, suffix arrays or BPE; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the stages' folders only the one that these rows are read from is left."""
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")  # the next stage has been written from it
    return STAGES[-1][1](spark, docs, sf_dir)
