"""The corpus pipeline: classify, drop repeated lines, drop near-duplicates, mix, pack.

Each stage reads what its predecessor wrote; all but the last return the columns of ``documents``. In every stage a very
long text is a batch alone and worked through whole, and columns keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.llm.common import load, table
from actloom.llm.line_dedup import drop_lines, line_bitmaps
from actloom.llm.mixing import mixed_documents
from actloom.llm.near_copies import near_copy_rows
from actloom.llm.packing import pack
from actloom.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit.

    Null and empty texts have no perplexity and go. Rows of one id and text have one verdict; null languages are one
    language; an empty table stays empty.
    """
    return keep_good(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more stay in one of them only.

    Null texts stay null. Rows of one id are one document, and so are those of no id. Every row stays.
    """
    return drop_lines(docs, line_bitmaps(docs))


#: Bits that SimHash candidates may differ by. MinHash bands reach the near copies beyond; wider SimHash links are
#: chance links in large corpora, whose number grows with the square of the documents.
NEAR_BITS = 3


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at a 5-word similarity of 0.8 or more: the one with the smallest id.

    Null ids come last; null and empty texts are copies of each other; of repeated rows one stays.
    """
    return near_copy_rows(docs, radius=NEAR_BITS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes whole, twice at most, or not at all.

    Null sources are one source; null ids and repeated rows take part like others.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row, null and empty texts having length 0."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: SQL can express neither the perplexities nor the fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
