"""Files as streams: what is new since the last run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.lineage import ensure_checkpoint_dir
from tessella.registry import query
from tessella.sources.views import Views


def take_new(spark: SparkSession, source: str, schema: str, target: str, progress: str, kind: str = "parquet") -> None:
    """Appends the rows of files that came since the last call to ``target``; ``progress`` remembers which were seen.

    A file counts once, whole; a run that is broken off is repeated without doubling rows.
    """
    stream = spark.readStream.schema(schema).format(kind).load(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


@query()
def incremental_tail(v: Views) -> DataFrame:
    spark, home = v.spark, f"{ensure_checkpoint_dir(v.spark)}/tail-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds nothing new
        take_new(spark, f"{v.sf_dir}/events.parquet*", "event_id bigint, user_id bigint, event_type string, value double", f"{home}/rows", f"{home}/progress")
    return spark.read.parquet(f"{home}/rows")
