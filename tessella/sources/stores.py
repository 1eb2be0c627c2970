"""Where rows come from and go to: folders of files, listings, snapshots, traces, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.registry import query
from tessella.sources.views import Views


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], skip: str | None = None, most: int | None = None) -> DataFrame:
    """``(path, length)`` of the files below a folder whose names end in one of the suffixes, whatever their case, by path."""
    pattern = "|".join(rf"\.{s}$" for s in suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").where(F.lower("path").rlike(pattern))
    if skip:
        files = files.where(~F.col("path").contains(f"/{skip}/"))
    ordered = files.orderBy("path")
    return ordered if most is None else ordered.limit(most)


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, sha256, first)``: each file's content hash and the first path of equal content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    return rows.join(rows.groupBy("sha256").agg(F.min("path").alias("first")), "sha256").select("path", "sha256", "first")


def split_columns(line: Column) -> Column:
    """The cells of a listing's line: two spaces or more end a cell."""
    return F.split(F.trim(line), r"\s{2,}")


def gpu_share(processor: Column) -> Column:
    """The percentage of work on the GPU from texts like ``40%/60% CPU/GPU``, ``100% GPU`` or ``30% CPU``."""
    both, gpu, cpu = (F.regexp_extract(processor, p, 1).try_cast("int") for p in (r"(?i)\d+%/(\d+)%\s*CPU/GPU", r"(?i)(\d+)%\s*GPU", r"(?i)(\d+)%\s*CPU"))
    return F.coalesce(both, gpu, 100 - cpu)


def snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """Writes tables as one version; a version that exists is an error, not overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{version}/{name}")


def restore(spark: SparkSession, folder: str, version: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in names}


def append_traces(df: DataFrame, folder: str) -> None:
    """Records as JSON lines, added to those that are there."""
    df.write.mode("append").json(folder)


def read_traces(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that are none are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def replace_partitions(df: DataFrame, folder: str, by: str) -> None:
    """Rewrites only the partitions that ``df`` has rows of; plain files have no merge."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


@query("""SELECT event_id, event_type AS name, user_id || ' GB' AS size, (event_id % 101)::INT AS gpu FROM events""")
def listing_table(v: Views) -> DataFrame:
    """Lines of a listing taken apart again."""
    share = F.col("event_id") % 101
    processor = F.when(F.col("event_id") % 3 == 0, F.concat(100 - share, F.lit("%/"), share, F.lit("% CPU/GPU"))).when(F.col("event_id") % 3 == 1, F.concat(share, F.lit("% GPU"))).otherwise(F.concat(100 - share, F.lit("% CPU")))
    line = F.concat(F.lit("  "), F.col("event_type"), F.lit("   "), F.col("user_id"), F.lit(" GB    "), processor, F.lit(" "))
    cells = v.table("events").select("event_id", split_columns(line).alias("c"))
    return cells.select("event_id", F.col("c")[0].alias("name"), F.col("c")[1].alias("size"), gpu_share(F.col("c")[2]).alias("gpu"))
