"""An event bus as a stream: a ring of the last events, and subscribers that are dropped once too much waits for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, ensure_checkpoint_dir
from tessella.plans.numbering import numbered
from tessella.registry import query
from tessella.sources.views import Views

#: Events that the ring holds, and events that may wait for a subscriber.
RING, QUEUE = 1000, 200
LOG = "seq long, kind string, subscriber string, upto long, body string"
SUBSCRIBERS = "subscriber string, upto long, dropped_at long"
EVENTS = "n long, seq long, body string"


class Bus:
    """The bus in the folder ``home``: a version of its tables for each batch, so that a batch that is repeated changes nothing.

    A log row (``LOG``) is an ``event`` with a body, a ``subscribe`` or ``unsubscribe``, or an ``ack``: the subscriber has taken
    the events up to number ``upto``. Rows count in the order of ``seq``, events are numbered from 1. An event that comes while
    ``queue`` events wait for a subscriber drops it, and what it acknowledges later is nothing, unless it subscribes anew; it
    then takes what comes from there on.
    """

    def __init__(self, spark: SparkSession, home: str, ring: int = RING, queue: int = QUEUE):
        self.spark, self.home, self.ring, self.queue = spark, home, ring, queue

    def _version(self, table: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.home}/{table}/version={batch}")

    def emit(self, log: DataFrame, batch: int) -> None:
        """Takes a batch of log rows in; ``foreachBatch`` calls it with the batch's number, again after a failure."""
        log = cut(log.select("seq", "kind", "subscriber", "upto", "body"))
        total = self._version("total", batch - 1, "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        events = cut(numbered(log.where("kind = 'event'").select("seq", "body"), "seq", start=total))
        after = events.agg(F.coalesce(F.max("n"), F.lit(total))).first()[0]
        put = lambda rows, table: rows.write.mode("overwrite").parquet(f"{self.home}/{table}/version={batch}")
        put(events.select("n", "seq", "body").where(F.col("n") > after - self.ring).union(self._version("ring", batch - 1, EVENTS).where(F.col("n") > after - self.ring)), "ring")
        put(self._subscribers(log, events, after, batch), "subscribers")
        put(self.spark.createDataFrame([(after,)], "n long"), "total")

    def _subscribers(self, log: DataFrame, events: DataFrame, after: int, batch: int) -> DataFrame:
        """The state of each subscriber after the batch; each row of one is met with the number of events before it.

        Rows between two subscriptions make a visit. What waits before a row of a visit is the number of events so far less
        the greatest number taken before.
        """
        moves = log.where("kind IN ('subscribe', 'unsubscribe', 'ack')")
        # the number of events before a move: the two are put in one order, an event's number standing for all before it
        marked = numbered(moves.select("seq", F.lit(1).alias("late"), "kind", "subscriber", "upto").union(events.select("seq", F.lit(0), F.lit("event"), F.lit(None).cast("string"), F.lit(None).cast("long"))), "seq", "late", name="place")
        own = numbered(marked.where("kind <> 'event'"), "place", name="move")
        start = self._version("total", batch - 1, "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        moved = own.select("subscriber", "kind", "upto", "move", (F.lit(start) + F.col("place") - F.col("move")).alias("so_far"))
        old = self._version("subscribers", batch - 1, SUBSCRIBERS).select("subscriber", F.lit("old").alias("kind"), "upto", F.lit(0).cast("long").alias("move"), F.lit(start).cast("long").alias("so_far"), "dropped_at")
        rows = old.unionByName(moved.withColumn("dropped_at", F.lit(None).cast("long")))
        by = W.partitionBy("subscriber").orderBy("move")
        begins = F.col("kind").isin("subscribe", "old")
        visits = rows.withColumn("visit", F.count_if(begins | (F.col("kind") == "unsubscribe")).over(by)).where("kind <> 'unsubscribe' AND visit > 0")
        taken = F.when(F.col("kind") == "subscribe", F.col("so_far")).when(F.col("kind") == "old", F.col("upto")).otherwise(F.least("upto", "so_far"))
        steps = visits.withColumn("taken", taken)
        within = W.partitionBy("subscriber", "visit").orderBy("move")
        before = F.max("taken").over(within.rowsBetween(W.unboundedPreceding, -1))
        late = F.when(F.col("so_far") - before > self.queue, before + self.queue + 1)
        dropped = F.min(F.coalesce("dropped_at", "late")).over(within.rowsBetween(W.unboundedPreceding, 0))
        counted = steps.withColumn("late", late).withColumn("dropped", dropped).withColumn("begun", F.max(begins.cast("int")).over(W.partitionBy("subscriber", "visit")))
        last = rows.groupBy("subscriber").agg(F.max_by("kind", "move").alias("last_kind"), F.max(F.when(F.col("kind") == "unsubscribe", F.col("move"))).alias("left"), F.max(F.when(begins, F.col("move"))).alias("came"))
        visit = F.max("visit").over(W.partitionBy("subscriber"))
        ends = counted.withColumn("final", visit).where("visit = final AND begun = 1").groupBy("subscriber").agg(F.max(F.when(F.col("dropped").isNull(), F.col("taken"))).alias("taken"), F.min("dropped").alias("dropped"), F.min("taken").alias("least"))
        kept = ends.join(last.where("left IS NULL OR came > left").select("subscriber"), "subscriber", "left_semi")
        upto = F.coalesce("taken", "least")
        drop = F.coalesce(F.col("dropped"), F.when(F.lit(after) - upto > self.queue, upto + self.queue + 1))
        return kept.select("subscriber", upto.alias("upto"), drop.cast("long").alias("dropped_at"))

    def recent(self, batch: int, limit: int = 50) -> DataFrame:
        """The last events of the ring, oldest first."""
        return self._version("ring", batch, EVENTS).orderBy(F.desc("n")).limit(limit).orderBy("n")

    def subscribers(self, batch: int) -> DataFrame:
        """``SUBSCRIBERS``: what each has taken, and the event that dropped it."""
        return self._version("subscribers", batch, SUBSCRIBERS)

    def run(self, log: DataFrame, progress: str) -> int:
        """Takes in all that a stream of log rows has, and returns the last batch's number."""
        stream = log.writeStream.foreachBatch(self.emit).option("checkpointLocation", progress).trigger(availableNow=True).start()
        stream.awaitTermination()
        return max((p["batchId"] for p in stream.recentProgress), default=-1)


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) AS n, 's' || user_id % 40 AS sub, event_type FROM events), total AS (SELECT count(*) AS n FROM e),
    moves AS (SELECT sub, n AS upto FROM e WHERE event_type = 'purchase' UNION ALL SELECT sub, NULL FROM (SELECT DISTINCT sub FROM e)),
    w AS (SELECT sub, coalesce(upto, total.n) AS so_far, upto, coalesce(max(upto) OVER (PARTITION BY sub ORDER BY upto NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM moves, total),
    d AS (SELECT sub, min(before) FILTER (so_far - before > 200) AS gap FROM w GROUP BY sub)
    SELECT sub AS subscriber, coalesce(d.gap, (SELECT max(coalesce(upto, before)) FROM w WHERE w.sub = d.sub)) AS upto, d.gap + 201 AS dropped_at FROM d""")
def bus_subscribers(v: Views) -> DataFrame:
    """All events over the bus in three batches; subscribers acknowledge all before one of their purchases."""
    spark, home = v.spark, f"{ensure_checkpoint_dir(v.spark)}/bus-{uuid.uuid4().hex}"
    each = cut(numbered(v.table("events").select("event_id", "user_id", "event_type"), "event_id"))
    name = F.concat(F.lit("s"), F.col("user_id") % 40)
    none = lambda kind: F.lit(None).cast(kind)
    log = each.select((F.col("n") * 2).alias("seq"), F.lit("event").alias("kind"), none("string").alias("subscriber"), none("long").alias("upto"), F.col("event_type").alias("body"))
    log = log.union(each.where("event_type = 'purchase'").select(F.col("n") * 2 + 1, F.lit("ack"), name, "n", none("string")))
    log = log.union(each.select(name.alias("s")).distinct().select(F.lit(1).cast("long"), F.lit("subscribe"), "s", none("long"), none("string")))
    size = (each.count() * 2 + 1) // 3 + 1  # the last row is an acknowledgement of the last event
    for third in range(3):
        log.where(F.expr(f"seq div {size}") == third).coalesce(1).write.mode("append").parquet(f"{home}/log")
    bus = Bus(spark, f"{home}/bus")
    return bus.subscribers(bus.run(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{home}/log"), f"{home}/progress"))
