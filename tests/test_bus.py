import random
from collections import deque

import pytest

from tessella.streaming import bus as B


def by_hand(log, ring, queue):
    """The loop: an event is put into each queue that has room; a full queue drops its subscriber."""
    held, queues, dropped, upto, n = deque(maxlen=ring), {}, {}, {}, 0
    for seq, kind, who, ack, body in sorted(log):
        if kind == "event":
            n += 1
            held.append((n, seq, body))
            for s in list(queues):
                if len(queues[s]) == queue:
                    dropped[s] = n
                    del queues[s]
                else:
                    queues[s].append(n)
        elif kind == "subscribe":
            queues[who], upto[who] = deque(), n
            dropped.pop(who, None)
        elif kind == "unsubscribe":
            queues.pop(who, None)
            dropped.pop(who, None)
            upto.pop(who, None)
        elif who in queues:
            while queues[who] and queues[who][0] <= ack:
                upto[who] = queues[who].popleft()
    return list(held), {s: (upto[s], dropped.get(s)) for s in upto}


@pytest.mark.parametrize("seed", [1, 2])
def test_bus_equals_the_loop_and_repeats_change_nothing(spark, tmp_path, seed):
    rng = random.Random(seed)
    log, n, known = [], 0, set()
    for seq in range(300):
        kind = rng.choices(["event", "ack", "subscribe", "unsubscribe"], [12, 4, 1, 0.4])[0]
        who = rng.choice("abcd")
        if kind == "subscribe" and who in known:
            kind = "ack"
        known |= {who} if kind == "subscribe" else set()
        known -= {who} if kind == "unsubscribe" else set()
        n += kind == "event"
        log.append((seq, kind, None if kind == "event" else who, rng.randint(max(0, n - 9), n + 1) if kind == "ack" else None, f"e{seq}" if kind == "event" else None))
    bus = B.Bus(spark, str(tmp_path / "bus"), ring=20, queue=7)
    ends = [0, 90, 91, 200, 300]
    for batch, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        df = spark.createDataFrame(rng.sample(log[a:b], b - a), B.LOG)
        for _ in range(1 + batch % 2):  # some batches come again
            bus.emit(df, batch)
        held, state = by_hand(log[:b], 20, 7)
        assert [tuple(r) for r in bus.recent(batch, 1000).collect()] == held
        assert {r["subscriber"]: (r["upto"], r["dropped_at"]) for r in bus.subscribers(batch).collect()} == state
    assert [r["n"] for r in bus.recent(3, 5).collect()] == [x[0] for x in held[-5:]]


def test_bus_of_nothing(spark, tmp_path):
    bus = B.Bus(spark, str(tmp_path / "bus"))
    bus.emit(spark.createDataFrame([], B.LOG), 0)
    assert bus.recent(0).count() == bus.subscribers(0).count() == 0
