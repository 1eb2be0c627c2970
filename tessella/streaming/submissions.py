"""An inbox as a stream of polls: a file is emitted once it has stopped growing, and submitted once while it is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.plans.lineage import cut, ensure_checkpoint_dir
from tessella.registry import query
from tessella.sources.views import Views

#: For a stream whose state does not fit into the executors' memory: keeps it on their disks.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STABLE = "path string, poll long, size long"
#: Of each path of a bucket: the poll and size seen last, whether it was emitted, and the time of that poll in seconds.
KNOWN = "paths array<string>, polls array<long>, sizes array<long>, emitted array<boolean>, seconds array<long>"
#: Buckets that paths are dealt into, and triggers that ``settled_files`` takes.
BUCKETS, TRIGGERS = 1024, 4


def submitted_once(submissions: DataFrame, late: str, path_col: str = "path", time_col: str = "at") -> DataFrame:
    """A stream of submissions with repeats of a path left out while one is in flight, that is for ``late`` after it.

    State holds the paths of that time, and goes with the watermark.
    """
    return submissions.withWatermark(time_col, late).dropDuplicatesWithinWatermark([path_col])


def settled(polls: DataFrame, late: str = "1 hour", forget_s: int = 86_400, buckets: int = BUCKETS) -> DataFrame:
    """``STABLE``: from a stream of polls (path, poll, size, at), each file at the first poll that finds it as large as the poll before.

    Polls are numbered; ``at`` is their time. A file is emitted once while polls find it; one that a poll did not find may come
    again. Polls later than ``late`` are left out. What is known of a path goes once the watermark is ``forget_s`` past its last poll.
    Paths are dealt into ``buckets``, a number that stays with the stream: a call for each path and trigger would cost
    milliseconds, most of it on the way to Python and back. State (``KNOWN``) has a row for each bucket, an entry for each path.
    """

    def followed(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A trigger's polls of a bucket in order; a poll has one row for a path."""
        seen = {path: known for path, *known in zip(*state.get, strict=True)} if state.exists else {}
        rows = {(int(p), int(s), int(t), path) for batch in batches for p, s, t, path in zip(batch["poll"], batch["size"], batch["seconds"], batch["path"], strict=True)}
        out = []
        for new, now, time, path in sorted(rows, key=itemgetter(0, 1, 2)):
            poll, size, emitted, _ = seen.get(path, (None, None, False, None))
            if poll is not None and new <= poll:
                continue  # a poll that came late
            if poll is not None and new > poll + 1:
                emitted = False  # it was gone in between
            elif poll is not None and now == size and not emitted:
                emitted = True
                out.append((path, new, now))
            seen[path] = (new, now, emitted, time)
        watermark = state.getCurrentWatermarkMs()
        kept = [(path, *known) for path, known in seen.items() if (known[-1] + forget_s) * 1000 >= watermark]
        if kept:
            state.update(tuple(map(list, zip(*kept, strict=True))))
            state.setTimeoutTimestamp((min(known[-1] for known in kept) + forget_s) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "poll", "size"])

    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket")
    timed = polls.withWatermark("at", late).select(bucket, "path", "poll", "size", "at", F.unix_timestamp("at").alias("seconds"))
    return timed.groupBy("bucket").applyInPandasWithState(followed, STABLE, KNOWN, "append", GroupStateTimeout.EventTimeTimeout)


def settled_batch(polls: DataFrame) -> DataFrame:
    """``settled`` of polls that are all there."""
    by = W.partitionBy("path").orderBy("poll")
    before = polls.select("path", "poll", "size").distinct().withColumn("p", F.lag("poll").over(by)).withColumn("s", F.lag("size").over(by))
    stays = before.withColumn("visit", F.count_if(F.col("p").isNull() | (F.col("poll") > F.col("p") + 1)).over(by))
    same = stays.where((F.col("poll") == F.col("p") + 1) & (F.col("size") == F.col("s")))
    return same.withColumn("n", F.row_number().over(W.partitionBy("path", "visit").orderBy("poll"))).where("n = 1").select("path", "poll", "size")


def polls_of(events: DataFrame) -> DataFrame:
    """A user's events as polls of a file: one an hour, its size what was counted so far in steps; some files are gone for a while.

    An event without a time belongs to no poll.
    """
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    each = events.where("ts IS NOT NULL").groupBy(F.concat(F.lit("inbox/"), F.col("user_id"), F.lit(".pdf")).alias("path"), hour.alias("poll")).agg(F.count("*").alias("n"))
    return each.select("path", "poll", F.timestamp_seconds(F.col("poll") * 3600).alias("at"), (F.sum("n").over(W.partitionBy("path").orderBy("poll")) / 3).cast("long").alias("size"))


@query("""WITH n AS (SELECT 'inbox/' || user_id || '.pdf' AS path, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS poll, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT path, poll, sum(n) OVER (PARTITION BY path ORDER BY poll) // 3 AS size FROM n),
    b AS (SELECT *, lag(poll) OVER w AS p, lag(size) OVER w AS s FROM p WINDOW w AS (PARTITION BY path ORDER BY poll)),
    v AS (SELECT *, count(*) FILTER (p IS NULL OR poll > p + 1) OVER (PARTITION BY path ORDER BY poll) AS visit FROM b)
    SELECT path, min(poll) AS poll, arg_min(size, poll)::BIGINT AS size FROM v WHERE poll = p + 1 AND size = s GROUP BY path, visit""")
def settled_files(v: Views) -> DataFrame:
    """The stream over all polls, a stretch of time for each of ``TRIGGERS`` triggers: more rows make larger triggers, not more."""
    spark, home = v.spark, f"{ensure_checkpoint_dir(v.spark)}/settled-{uuid.uuid4().hex}"
    polls = cut(polls_of(v.table("events")))
    ends = polls.approxQuantile("poll", [k / TRIGGERS for k in range(1, TRIGGERS)], 0.01)
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")  # a trigger without rows would only forget paths, which the next one does as well
    try:
        for after, end in pairwise([float("-inf"), *ends, float("inf")]):
            polls.where((F.col("poll") > after) & (F.col("poll") <= end)).write.mode("append").parquet(f"{home}/polls")
            stream = spark.readStream.schema(polls.schema).parquet(f"{home}/polls")
            run = settled(stream).writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/progress")
            run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)
    return spark.read.schema(STABLE).parquet(f"{home}/rows")
