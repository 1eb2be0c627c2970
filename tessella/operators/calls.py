"""Calls to models from tasks: a bounded number at a time, retried after growing waits, given up at a document's deadline."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut
from tessella.registry import query
from tessella.sources.views import Views

#: Calls of a task at a time, seconds before each further attempt, seconds for all calls of a document, rows of a batch.
IN_FLIGHT, WAITS, DEADLINE, BATCH = 4, (2.0, 4.0, 8.0), 600.0, 256


def called(call: Callable[[Any], Any], payloads: list, ends: float, in_flight: int = IN_FLIGHT, waits: tuple[float, ...] = WAITS) -> list[tuple[Any, str | None, int]]:
    """``(result, reason, attempts)`` for each payload, in order; a result is null with the reason of its last failure.

    ``in_flight`` threads take payloads in order. What is not there at ``ends`` (of ``time.monotonic``) has the reason ``deadline``: waits
    end, payloads not yet taken are not called, and a call that hangs is left behind with its thread, which ends with
    the process and cannot change a result any more.
    """
    out: list[tuple[Any, str | None, int]] = [(None, "deadline", 0)] * len(payloads)
    lock, stop = threading.Condition(), threading.Event()
    left, open_ = iter(enumerate(payloads)), len(payloads)

    def put(i: int, value: tuple[Any, str | None, int], done: bool) -> None:
        nonlocal open_
        with lock:
            if not stop.is_set():
                out[i] = value
                open_ -= done
                lock.notify()

    def work() -> None:
        while not stop.is_set():
            with lock:
                i, payload = next(left, (None, None))
            if i is None:
                return
            for attempt in range(1, len(waits) + 2):
                put(i, (None, "deadline", attempt), False)
                try:
                    put(i, (call(payload), None, attempt), True)
                    break
                except Exception as e:  # whatever a model raises is a reason
                    if attempt > len(waits):
                        put(i, (None, f"{type(e).__name__}: {e}", attempt), True)
                    elif stop.wait(waits[attempt - 1]):
                        return

    for _ in range(min(in_flight, len(payloads))):
        threading.Thread(target=work, daemon=True).start()
    with lock:
        lock.wait_for(lambda: not open_, max(0.0, ends - time.monotonic()))
        stop.set()
        return list(out)


def bounded_calls(rows: DataFrame, call: Callable[[Any], Any], result: str = "string", in_flight: int = IN_FLIGHT, waits: tuple[float, ...] = WAITS, deadline: float = DEADLINE) -> DataFrame:
    """``(doc_id, id, result, reason, attempts)`` of ``rows`` (doc_id, id, payload) by a function of a payload.

    A document's rows are taken in the order of their ids by one task, which holds a batch of them. Its deadline runs from its
    first call, so a document of very many rows keeps a task no longer than that; the rest has the reason ``deadline``. A null
    payload is not called and has the reason ``no payload``. ``call`` may be called again for a payload if a task is repeated.
    A null document is one of its own. An empty table gives an empty result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.select("doc_id", "id").schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, ends, first = None, 0.0, True
        for batch in batches:
            found: list[tuple[Any, str | None, int]] = []
            docs = [None if pd.isna(d) else d for d in batch["doc_id"]]
            for d, group in groupby(zip(docs, batch["payload"], strict=True), key=lambda x: x[0]):
                payloads = [p for _, p in group]
                if first or d != doc:
                    doc, ends, first = d, time.monotonic() + deadline, False
                asked = iter(called(call, [p for p in payloads if p is not None], ends, in_flight, waits))
                found += [(None, "no payload", 0) if p is None else next(asked) for p in payloads]
            out = pd.DataFrame(found, columns=["result", "reason", "attempts"])
            yield pd.concat([batch[["doc_id", "id"]].reset_index(drop=True), out], axis=1)

    ordered = rows.select("doc_id", "id", "payload").repartition("doc_id").sortWithinPartitions("doc_id", "id")
    with arrow_rows(rows.sparkSession, BATCH):
        return cut(ordered.mapInPandas(run, f"doc_id {kinds['doc_id']}, id {kinds['id']}, result {result}, reason string, attempts int"))


class Moody:
    """A model for tests: it answers some payloads at once, some at the second attempt and some never."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, text: str) -> str:
        if len(text) % 7 == 0:
            raise ValueError("not this one")
        if len(text) % 5 == 0 and text not in self.seen:
            self.seen.add(text)
            raise TimeoutError("later")
        return f"Bild: {text[:20]}"


@query("""SELECT doc_id, id, CASE WHEN length(caption) % 7 <> 0 THEN 'Bild: ' || left(caption, 20) END AS result,
    CASE WHEN caption IS NULL THEN 'no payload' WHEN length(caption) % 7 = 0 THEN 'ValueError: not this one' END AS reason,
    CASE WHEN caption IS NULL THEN 0 WHEN length(caption) % 7 = 0 THEN 3 WHEN length(caption) % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM (SELECT doc_id, id, id || ' ' || caption AS caption FROM chunks)""")
def captions(v: Views) -> DataFrame:
    """Images described by a model that fails now and then; with short waits."""
    rows = v.chunks.select("doc_id", "id", F.concat(F.col("id").cast("string"), F.lit(" "), "caption").alias("payload"))
    return bounded_calls(rows, Moody(), waits=(0.001, 0.001))
