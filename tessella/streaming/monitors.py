"""Monitors, quotas and rings over events, as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.registry import query
from tessella.sources.views import Views

SECONDS = "epoch(ts)::BIGINT"


def _events(v: Views) -> DataFrame:
    return v.table("events").withColumn("s", F.unix_timestamp("ts"))


EVENTS = "ev AS (SELECT * , floor(epoch(ts))::BIGINT AS s FROM events)"


@query(f"""WITH {EVENTS}, w AS (SELECT user_id, event_id, event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM ev)
    SELECT user_id, event_id, old, new, CASE WHEN old = 'view' THEN 'error' WHEN new <> 'view' THEN 'warning' ELSE 'info' END AS severity FROM w WHERE old IS NOT NULL AND old <> new""")
def state_changes(v: Views, running: str = "view") -> DataFrame:
    """Changes from a service's last state; its first poll is silent. Leaving the running state is an error."""
    old = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = v.table("events").select("user_id", "event_id", old.alias("old"), F.col("event_type").alias("new")).where("old IS NOT NULL AND old <> new")
    return rows.withColumn("severity", F.when(F.col("old") == running, "error").when(F.col("new") != running, "warning").otherwise("info"))


@query(f"""WITH {EVENTS}, polls AS (SELECT s // 86400 AS poll, list_sort(list(DISTINCT user_id % 20) FILTER (event_type = 'purchase')) AS cur FROM ev GROUP BY 1),
    l AS (SELECT poll, coalesce(cur, []) AS cur, lag(coalesce(cur, [])) OVER (ORDER BY poll) AS prev FROM polls)
    SELECT poll, array_to_string(CASE WHEN len(prev) > 0 THEN list_sort(list_filter(cur, lambda x: NOT list_contains(prev, x))) ELSE [] END, ',') AS loaded, array_to_string(list_sort(list_filter(prev, lambda x: NOT list_contains(cur, x))), ',') AS unloaded FROM l WHERE prev IS NOT NULL""")
def snapshot_diff(v: Views) -> DataFrame:
    """What appeared and what went between daily snapshots; nothing is said to appear after an empty one. A row for each day."""
    polls = _events(v).groupBy(F.expr("s div 86400").alias("poll")).agg(F.array_sort(F.collect_set(F.when(F.col("event_type") == "purchase", F.col("user_id") % 20))).alias("cur"))
    both = polls.withColumn("prev", F.lag("cur").over(W.orderBy("poll"))).where("prev IS NOT NULL")  # one row a day
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return both.select("poll", F.when(F.size("prev") > 0, joined(F.array_except("cur", "prev"))).otherwise("").alias("loaded"), joined(F.array_except("prev", "cur")).alias("unloaded"))


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, s // 43200 AS slot, count(*) FILTER (event_type = 'click') AS active FROM ev GROUP BY 1, 2), l AS (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY slot) AS prev FROM b)
    SELECT user_id, slot, CASE WHEN active > 0 THEN 'started' ELSE 'idle' END AS edge FROM l WHERE (active > 0) <> (coalesce(prev, 0) > 0)""")
def activity_edges(v: Views) -> DataFrame:
    """When a service becomes active, or idle again; before the first poll it is idle."""
    slots = _events(v).groupBy("user_id", F.expr("s div 43200").alias("slot")).agg(F.count_if(F.col("event_type") == "click").alias("active"))
    prev = F.coalesce(F.lag("active").over(W.partitionBy("user_id").orderBy("slot")), F.lit(0))
    return slots.withColumn("prev", prev).where((F.col("active") > 0) != (F.col("prev") > 0)).select("user_id", "slot", F.when(F.col("active") > 0, "started").otherwise("idle").alias("edge"))


@query("WITH ring AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) SELECT event_id, user_id, event_type FROM (SELECT * FROM ring WHERE event_type = 'error' AND props ILIKE '%\"k\": 1%' ORDER BY event_id DESC LIMIT 50) ORDER BY event_id")
def recent_events(v: Views, held: int = 1000, limit: int = 50) -> DataFrame:
    """The last events that a ring of ``held`` still has and that pass the filters, oldest first."""
    ring = v.table("events").orderBy(F.desc("event_id")).limit(held)
    hits = ring.where((F.col("event_type") == "error") & F.lower("props").contains('"k": 1'))
    return hits.orderBy(F.desc("event_id")).limit(limit).orderBy("event_id").select("event_id", "user_id", "event_type")


@query("""WITH f AS (SELECT user_id, event_id, props AS size, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), s AS (SELECT user_id, min(event_id) AS event_id FROM f WHERE size = before GROUP BY 1) SELECT user_id, event_id FROM s""")
def stable_files(v: Views) -> DataFrame:
    """A file is taken once, at the first poll that finds it as large as the poll before."""
    before = F.lag("props").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.table("events").select("user_id", "event_id", "props", before.alias("before")).where("props = before").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query(f"""WITH {EVENTS}, n AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id, s // 3600 ORDER BY ts, event_id) AS n FROM ev)
    SELECT event_id, n <= 2 AS allowed, greatest(2 - n, 0) AS remaining, CASE WHEN n > 2 THEN greatest(1, (s // 3600 + 1) * 3600 - s) END AS retry_after FROM n""")
def rate_limit_fixed(v: Views, limit: int = 2) -> DataFrame:
    """So many requests an hour, hours counted from the epoch."""
    n = F.row_number().over(W.partitionBy("user_id", F.expr("s div 3600")).orderBy("ts", "event_id"))
    rows = _events(v).select("event_id", "s", n.alias("n"))
    return rows.select("event_id", (F.col("n") <= limit).alias("allowed"), F.greatest(limit - F.col("n"), F.lit(0)).alias("remaining"), F.when(F.col("n") > limit, F.greatest(F.lit(1), F.expr("(s div 3600 + 1) * 3600 - s"))).alias("retry_after"))


def sliding(times: list[int], taken: list[int], limit: int, window: int = 3600) -> tuple[list[tuple[bool, int, int]], list[int]]:
    """Decisions for requests at ``times``, given those allowed before; only allowed ones fill the window."""
    out = []
    for now in times:
        taken = [t for t in taken if t > now - window]
        if len(taken) >= limit:
            out.append((False, 0, max(1, taken[0] + window - now)))
        else:
            taken.append(now)
            out.append((True, limit - len(taken), 0))
    return out, taken


@query()
def rate_limit_sliding(v: Views, limit: int = 2) -> DataFrame:
    """The sliding hour, folded over each user's requests in order: partitions are sorted by Spark, and a user's window goes
    from batch to batch, so no user's history is held."""

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = object(), []
        for batch in batches:
            rows = []
            for user, event_id, now in zip(batch["user_id"].tolist(), batch["event_id"].tolist(), batch["s"].tolist(), strict=True):
                if user != at:
                    at, taken = user, []
                (decision,), taken = sliding([now], taken, limit)
                rows.append((event_id, *decision))
            yield pd.DataFrame(rows, columns=["event_id", "allowed", "remaining", "retry_after"])

    ordered = _events(v).select("user_id", "event_id", "s").repartition("user_id").sortWithinPartitions("user_id", "s", "event_id")
    return ordered.mapInPandas(folded, "event_id long, allowed boolean, remaining int, retry_after int")


def _whole(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All rows that a trigger brings for a key, in order; they may come in several batches."""
    return pd.concat(list(batches)).sort_values(list(order))


def stream_changes(events: DataFrame, running: str = "view") -> DataFrame:
    """``state_changes`` over a stream of (user_id, event_id, event_type): the last state of a service is its state.

    A trigger's rows of a service are put in order as a whole; rows of an earlier trigger come before. State grows with the
    number of services, one word each, and is kept, as a service that was silent for long still has its last state.
    """

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for e in _whole(batches, "event_id").itertuples():
            if last is not None and e.event_type != last:
                rows.append((key[0], e.event_id, last, e.event_type, "error" if last == running else "warning" if e.event_type != running else "info"))
            last = e.event_type
        state.update((last,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "old", "new", "severity"])

    return events.groupBy("user_id").applyInPandasWithState(changed, "user_id long, event_id long, old string, new string, severity string", "last string", "append", GroupStateTimeout.NoTimeout)


def stream_quota(events: DataFrame, limit: int, window: int = 3600, late: str = "1 day") -> DataFrame:
    """``rate_limit_sliding`` over a stream of (user_id, event_id, s): the times allowed in the last hour are the state.

    A trigger's rows of a user are put in order as a whole. Rows later than ``late`` are left out; a user's state goes once the
    watermark is a window past the user's last request.
    """

    def decided(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _whole(batches, "s", "event_id")
        out, taken = sliding(rows["s"].tolist(), list(state.get[0]) if state.exists else [], limit, window)
        state.update((taken,))
        state.setTimeoutTimestamp(int(rows["s"].max() + window) * 1000)
        yield pd.DataFrame(out, columns=["allowed", "remaining", "retry_after"]).assign(event_id=rows["event_id"].to_numpy())

    timed = events.select("user_id", "event_id", "s", F.timestamp_seconds("s").alias("at")).withWatermark("at", late)
    return timed.groupBy("user_id").applyInPandasWithState(decided, "event_id long, allowed boolean, remaining int, retry_after int", "taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of a stream, with rows later than ``late`` left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type AS state, count(*) AS n, avg(value) FILTER (event_id % 5 <> 0) IS NOT NULL AS known, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 4) AS mean FROM events GROUP BY 1")
def run_averages(v: Views) -> DataFrame:
    """Averages that pass over missing measurements."""
    value = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return v.table("events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.avg(value).isNotNull().alias("known"), F.round(F.avg(value), 4).alias("mean"))
