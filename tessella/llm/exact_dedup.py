"""Exact duplicates by sorting content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A text is hot if it holds more than one row in so many; so at most this many texts are hot.
HOT_SHARE = 1024
#: Characters of a text that splitters are sampled from; a hash of the whole text follows them.
PREFIX = 64
#: Parts into which the rows of a hot text are dealt.
SALTS = 64


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of each row's group of equal texts.

    Splitters sampled by Spark range-partition the normalised bytes, each partition is sorted (spilling to disk), and
    a window over the sorted run compares whole neighbouring texts; the smallest id of a run stays. The window asks
    for no further exchange, as the range partitioning already holds equal texts together. Texts are ordered by their
    first ``PREFIX`` characters, a hash and then the whole text, so the driver's sample of splitters holds no whole
    texts, and a first line that many texts share can still be split.

    A text with more than a ``1 / hot_share`` part of all rows would make one partition large. Such texts are found
    by counting 64-bit hashes; there are fewer than ``hot_share`` of them, so the table of their smallest id and count,
    aggregated before its shuffle and keyed by SHA-256, may be broadcast. Their rows are dealt to ``salts`` runs by id and by the
    partition they come from, so rows of one repeated or null id are dealt out too; only those of the smallest id itself stay together,
    as one of them is kept.

    Null text counts as empty. A null id is never the smallest while another id exists; if all ids of a group are
    null, ``keep_id`` is null and one of the rows stays. Of repeated rows (same id and text) exactly one stays. Input
    columns named like an output column are replaced. An empty table gives an empty result.
    """
    out = ("keep_id", "group_size", "kept", "text_sha256")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", F.xxhash64("norm"))
    total = docs.count()
    often = rows.groupBy("h").count().where(F.col("count") > max(1, total // hot_share)).select("h")
    hot = (
        rows.join(F.broadcast(often), "h", "left_semi")
        .groupBy("norm")
        .agg(F.min("id").alias("hot_id"), F.count("*").alias("hot_size"))
        .select(F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("hot_sha"), "hot_id", "hot_size")
    )
    source = F.when(F.col("id").eqNullSafe(F.col("hot_id")), F.lit(-1)).otherwise(F.spark_partition_id())
    # sha2 is only worked out for rows whose hash is among the hot ones
    marked = rows.join(F.broadcast(hot), (rows["h"] == hot["h"]) & (F.sha2(rows["norm"], 256) == hot["hot_sha"]), "left").select(
        "row", "id", "norm", F.left("norm", F.lit(PREFIX)).alias("prefix"), rows["h"].alias("h"), "hot_id", "hot_size", F.when(F.col("hot_size").isNotNull(), F.pmod(F.xxhash64("id", source), F.lit(salts))).otherwise(F.lit(0)).alias("salt")
    )
    order = ["prefix", "h", "salt"]
    run = W.partitionBy(*order, "norm")
    return (
        marked.repartitionByRange(*order)
        .withColumn("n", F.row_number().over(run.orderBy(F.col("id").asc_nulls_last())))
        .withColumn("first_id", F.min("id").over(run))
        .withColumn("size", F.count("*").over(run))
        .select(
            *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in out],
            F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).otherwise(F.col("first_id")).alias("keep_id"),
            F.coalesce("hot_size", "size").alias("group_size"),
            ((F.col("n") == 1) & F.col("first_id").eqNullSafe(F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).otherwise(F.col("first_id")))).alias("kept"),
            F.sha2("norm", 256).alias("text_sha256"),
        )
    )
