"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; documents may be long, so batches are short.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows of an Arrow batch, as a batch of very long texts must fit in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for what is computed within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True for the rows whose crc32 of the id's text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Text and label of at most ``max_rows`` labelled rows for which ``train`` holds, on the driver.

    The rows are those whose ids hash lowest, so the sample does not depend on partitions. They are chosen from the
    labels alone, at most ``max_rows`` of them, so the chosen ids may be broadcast and no text is shuffled. Texts of
    more than ``max_chars`` characters are left out of the sample (not of scoring). Labels other than 0 and 1 and null
    ids are ignored; of several labels of one id the larger holds, of several texts the first in order; null text counts as empty.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & train)
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("label_"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_rows)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.where(F.length(text) <= max_chars).join(F.broadcast(chosen), id_col).select(id_col, text.alias("text_"), "label_")
    rows = found.groupBy(id_col).agg(F.min("text_").alias("text_"), F.first("label_").alias("label_"))
    return [(r["text_"], r["label_"]) for r in sorted(rows.collect(), key=lambda r: r[id_col])]
