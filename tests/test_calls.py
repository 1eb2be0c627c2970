import threading
import time

from tessella.operators import calls as C


def soon(seconds=5.0):
    return time.monotonic() + seconds


def test_results_keep_their_order_and_failures_their_reasons():
    tries = {}

    def call(x):
        tries[x] = tries.get(x, 0) + 1
        if x == 3 or (x == 5 and tries[x] < 3):
            raise ValueError(f"no {x}")
        time.sleep(0.02 * (7 - x))
        return x * 10

    got = C.called(call, list(range(7)), soon(), 3, (0.01, 0.01))
    assert got == [(0, None, 1), (10, None, 1), (20, None, 1), (None, "ValueError: no 3", 3), (40, None, 1), (50, None, 3), (60, None, 1)]
    assert C.called(call, [], soon()) == []


def test_no_more_calls_than_allowed_are_in_flight():
    lock, now, most = threading.Lock(), 0, 0

    def call(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01)
        with lock:
            now -= 1
        return x

    assert [r for r, *_ in C.called(call, list(range(30)), soon(), 4)] == list(range(30)) and most == 4


def test_waits_grow_and_end_with_the_deadline():
    at = []

    def call(_):
        at.append(time.monotonic())
        raise OSError("down")

    began = time.monotonic()
    assert C.called(call, ["x"], soon(), 1, (0.05, 0.1, 0.2)) == [(None, "OSError: down", 4)]
    gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
    assert [g >= w for g, w in zip(gaps, (0.05, 0.1, 0.2), strict=True)] == [True] * 3
    began = time.monotonic()
    assert C.called(call, ["x", "y"], soon(0.3), 1, (60,)) == [(None, "deadline", 1), (None, "deadline", 0)]
    assert time.monotonic() - began < 2


def test_a_call_that_hangs_is_left_behind():
    free = threading.Event()
    began = time.monotonic()
    got = C.called(lambda x: free.wait(60) if x == "hang" else x, ["a", "hang", "b", "c"], soon(0.5), 2, ())
    assert got == [("a", None, 1), (None, "deadline", 1), ("b", None, 1), ("c", None, 1)] and time.monotonic() - began < 3
    free.set()
    time.sleep(0.05)
    assert got[1] == (None, "deadline", 1)


class Sleepy:
    def __call__(self, text):
        if text == "fails":
            raise ValueError("bad")
        if text == "hangs":
            time.sleep(600)
        return len(text)


def test_documents_have_deadlines_of_their_own(spark):
    rows = [(1, 1, "one"), (1, 2, "hangs"), (1, 3, "hangs"), (1, 4, "four"), (2, 5, "fails"), (2, 6, None), (2, 7, "seven"), (None, 8, "x"), (3, 9, ""), (2, 5, "again")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, id long, payload string, result string").repartition(3)
    began = time.monotonic()
    got = {(r["id"], r["result"], r["reason"], r["attempts"]) for r in C.bounded_calls(df, Sleepy(), "int", 2, (0.01,), 1.0).collect()}
    assert got == {(1, 3, None, 1), (2, None, "deadline", 1), (3, None, "deadline", 1), (4, None, "deadline", 0), (5, None, "ValueError: bad", 2), (6, None, "no payload", 0), (7, 5, None, 1), (8, 1, None, 1), (9, 0, None, 1), (5, 5, None, 1)}
    assert time.monotonic() - began < 60
    assert C.bounded_calls(df.limit(0), Sleepy(), "int").count() == 0
