"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes documents and all but the last return documents: the columns of ``COLUMNS``, whatever others came in. In all of
them a null text counts as empty and a null id comes after all others; an empty table gives an empty result; texts are read
whole, however long. Ties are broken by the smaller id. Rows that repeat an id are rows of their own: decisions are about rows,
not ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.frames import held_out, table
from tessella.llm.near_copies import near_copies
from tessella.llm.packing import pack_documents
from tessella.llm.suffix_dedup import remove_repeats
from tessella.llm.toxicity import score_toxicity
from tessella.plans.lineage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; equal texts fare alike, null and empty texts score by the share of toxic labels."""
    scored = score_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return scored.where("predicted = 0").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, and of rows that repeat it one."""
    return exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more, over shingles of five words, the row with the smallest id stays."""
    return near_copies(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also occur earlier go; every document stays, with what is left of it."""
    left = remove_repeats(docs.select(*COLUMNS), as_text=True)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of tokens; an empty document is one piece."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("repeated passages", repeats), ("packing", pack)]

#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents; each stage's rows are computed once and kept for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
