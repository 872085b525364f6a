"""The corpus pipeline: quality, near copies, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared checkpoint folder and read again as the next
stage's ``docs``. All stages but the last return the columns of documents.

1. ``quality``: documents that the weak-label classifier rejects go.
2. ``near_duplicates``: of every group of documents linked by a five-word
   shingle similarity of 0.8 or more the smallest id stays.
3. ``repeated_passages``: words inside a passage of 50 words or more that a
   document with a smaller id holds too go; a document that loses all its
   words goes.
4. ``personal_data``: confirmed spans become their kind in brackets.
5. ``packing``: ids, cut at 2048, packed into sequences; one row per piece.

Defined cases: ``quality`` rejects null, empty and white-space texts; a null
id stays where the text is good (it links with nothing, loses no passage, is
redacted and packed); of equal texts the smallest id stays, and rows that
repeat an id stay or go together; very long texts are read whole; an empty
table gives no rows; further columns keep their names and values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourglass.llm import jaccard, packing, pii, quality, substring
from hourglass.llm.common import Scratch, read_table

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_per_component(docs, Scratch(spark, "pipeline-jaccard")).select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs, Scratch(spark, "pipeline-substring"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_pii(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline-pack")
    pieces = packing.tokenised_pieces(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(scratch.put(pieces, "pieces"), scratch)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
