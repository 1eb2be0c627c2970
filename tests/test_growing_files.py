import datetime
import random

import pytest

from tessella.streaming import submissions as S
from tessella.streaming import tail as T


def lines_of(spark, out):
    return [(r["file"].rsplit("/", 1)[-1], r["offset"], r["line"]) for r in spark.read.parquet(out).orderBy("file", "offset").collect()]


def test_appended_lines_come_once_over_restarts(spark, tmp_path):
    home, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    take = lambda: T.take_appended(spark, str(home), out, progress, names="*.jsonl", partBytes=7)
    home.mkdir()
    (home / "a.jsonl").write_bytes("eins ü\nzwei\nhal".encode())
    (home / "b.txt").write_text("not asked for\n")
    take()
    assert lines_of(spark, out) == [("a.jsonl", 0, "eins ü"), ("a.jsonl", 8, "zwei")]
    with (home / "a.jsonl").open("ab") as f:
        f.write(b"b\n\n" + b"long " * 20 + b"\r\nopen")
    (home / "c.jsonl").write_text("new\n")
    take()
    take()
    want = [("a.jsonl", 0, "eins ü"), ("a.jsonl", 8, "zwei"), ("a.jsonl", 13, "halb"), ("a.jsonl", 18, ""), ("a.jsonl", 19, "long " * 20), ("c.jsonl", 0, "new")]
    assert lines_of(spark, out) == want
    with (home / "a.jsonl").open("ab") as f:
        f.write(b" end\n")
    take()
    assert lines_of(spark, out) == sorted([*want, ("a.jsonl", 121, "open end")])


@pytest.mark.parametrize("part", [1, 5, 1000])
def test_parts_share_out_lines(tmp_path, part):
    rng = random.Random(part)
    text = "".join(rng.choice("ab\n") for _ in range(300)) + "\n"
    (tmp_path / "x").write_text(text)
    reader = T.TailReader({"path": str(tmp_path), "partBytes": str(part)})
    got = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    assert [line for _, _, line in got] == text.split("\n")[:-1]
    assert all(text[at:].startswith(line + "\n") for _, at, line in got)


def test_offsets_of_files_that_shrink_vanish_or_are_not_there(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    path = tmp_path / "x"
    reader = T.TailReader({"path": str(tmp_path)})
    assert T.TailReader({"path": str(tmp_path / "none")}).latestOffset() == {}
    path.write_text("one\ntwo\nthr")
    first = reader.latestOffset()
    assert list(first.values()) == [8] and T.TailReader({"path": str(tmp_path), "from": "end"}).initialOffset() == first
    path.write_text("new\n")
    second = reader.latestOffset()
    assert [r[2] for p in reader.partitions(first, second) for r in reader.read(p)] == ["new"]
    path.unlink()
    assert reader.latestOffset() == {} and reader.partitions(second, {}) == []


def start(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def by_hand(polls):
    """The watcher's loop: sizes known from the poll before, and what was taken while it is there."""
    known, taken, out = {}, set(), []
    for n in range(min(p for _, p, _ in polls), max(p for _, p, _ in polls) + 1):
        now = {path: size for path, p, size in polls if p == n}
        for path, size in now.items():
            if path not in taken and known.get(path) == size:
                taken.add(path)
                out.append((path, n, size))
        known, taken = now, {p for p in taken if p in now}
    return sorted(out)


def streamed(spark, tmp_path, df_of, rows, build, cuts, settings=()):
    source, out, progress = (str(tmp_path / x) for x in ("src", "out", "progress"))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        df = df_of(rows[a:b])
        df.coalesce(1).write.mode("append").parquet(source)
        run = build(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        for k, v in settings:
            spark.conf.set(k, v)
        try:
            query = run.trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, _ in settings:
                spark.conf.unset(k)
    return spark.read.parquet(out), query


def test_files_that_stopped_growing(spark, tmp_path):
    rng = random.Random(5)
    polls = [(f"f{f}", n, rng.choice([1, 1, 2])) for f in range(6) for n in range(20) if rng.random() < 0.8]
    polls.sort(key=lambda p: p[1])
    df_of = lambda rows: spark.createDataFrame([(*r, start(r[1] * 3600)) for r in rows], "path string, poll long, size long, at timestamp")
    want = by_hand(polls)
    assert sorted(tuple(r) for r in S.settled_batch(df_of(polls)).collect()) == want
    ends = [next(i for i, p in enumerate(polls) if p[1] == n) for n in (7, 8, 15)]
    got, _ = streamed(spark, tmp_path, df_of, polls, S.settled, ends, [S.PROVIDER])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_submission_in_flight_is_not_repeated(spark, tmp_path):
    """The same path twice: once. Long after, it may come again; state goes with the watermark."""
    rows = [("a", 0), ("a", 5), ("b", 6), ("a", 30), ("c", 5000), ("d", 5001), ("a", 5002), ("a", 5003)]
    df_of = lambda part: spark.createDataFrame([(p, start(s)) for p, s in part], "path string, at timestamp")
    got, query = streamed(spark, tmp_path, df_of, rows, lambda s: S.submitted_once(s, "60 seconds"), [2, 4, 6])
    assert sorted((r["path"], r["at"]) for r in got.collect()) == sorted((p, start(s)) for p, s in [("a", 0), ("b", 6), ("c", 5000), ("d", 5001), ("a", 5002)])
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # what was in flight at first is forgotten


def test_polls_of_the_last_half_second_of_an_hour(spark, tmp_path):
    """The SQL counts an event in the hour that it lies in, as the query does, not in that of its rounded second."""
    import duckdb

    from tessella.registry import ORACLE_SQL

    times = ["08:00:00", "09:59:59.7", "10:00:00", "11:00:00.2", "11:59:59.999999", "13:00:00"]
    events = spark.createDataFrame([(1, datetime.datetime.fromisoformat(f"2024-01-01T{t}")) for t in times], "user_id long, ts timestamp")
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute("CREATE TABLE events AS SELECT 1 AS user_id, unnest(?)::TIMESTAMP AS ts", [[f"2024-01-01 {t}" for t in times]])
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[], label INT)")
    want = {r for r in db.execute(ORACLE_SQL["settled_files"]).fetchall()}
    got = {tuple(r) for r in S.settled_batch(S.polls_of(events)).collect()}
    assert got == want
    assert len(got) == 1


def test_paths_of_a_bucket_are_followed_one_by_one(spark, tmp_path):
    """State has a row for each bucket, whatever the number of paths; a path without polls for long is forgotten, its bucket stays."""
    rng = random.Random(7)
    polls = [(f"f{f}", n, rng.choice([1, 1, 2])) for n in range(12) for f in range(40) if rng.random() < 0.8]
    polls += [("gone", 0, 5), (None, 2, 5), (None, 3, 5)]
    polls = sorted(polls, key=lambda p: p[1])
    df_of = lambda rows: spark.createDataFrame([(*r, start(r[1] * 3600)) for r in rows], "path string, poll long, size long, at timestamp")
    ends = [next(i for i, p in enumerate(polls) if p[1] == n) for n in (3, 4, 9)]
    got, query = streamed(spark, tmp_path, df_of, polls, lambda s: S.settled(s, forget_s=4 * 3600, buckets=3), ends, [S.PROVIDER])
    assert {tuple(r) for r in got.collect()} == set(by_hand([p for p in polls if p[0]])) | {(None, 3, 5)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_a_path_is_forgotten_after_a_while(spark, tmp_path):
    """Polls of "a" are numbered on, but a day lies between: what was known of it went with the watermark; that of "b" did not."""
    rows = [("a", 1, 5, 0), ("b", 1, 5, 0), ("b", 2, 6, 80_000), ("c", 1, 5, 100_000), ("c", 2, 4, 100_001), ("a", 2, 5, 100_002), ("b", 3, 6, 100_002)]
    df_of = lambda part: spark.createDataFrame([(p, n, s, start(t)) for p, n, s, t in part], "path string, poll long, size long, at timestamp")
    got, _ = streamed(spark, tmp_path, df_of, rows, lambda s: S.settled(s, buckets=1), [2, 3, 4, 5], [S.PROVIDER])
    assert [tuple(r) for r in got.collect()] == [("b", 3, 6)]


def test_more_rows_make_no_more_triggers(spark, tmp_path, monkeypatch):
    """Whatever the number of rows, ``TRIGGERS`` runs over stretches of time, with the rows of the SQL; events without a time count nowhere."""
    import duckdb

    from tessella.registry import ORACLE_SQL, QUERIES

    runs = []
    monkeypatch.setattr(S, "settled", lambda polls, f=S.settled: runs.append(1) or f(polls, buckets=16))
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute("""CREATE TABLE events AS SELECT i % 2500 AS user_id, CASE WHEN i % 97 <> 5 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (i * 7919 % 432000) END AS ts FROM range(110000) r(i)
        UNION ALL SELECT NULL, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * i FROM range(4) r(i)""")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding FLOAT[], label INT)")
    want = sorted(db.execute(ORACLE_SQL["settled_files"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES["settled_files"](spark, str(tmp_path)).collect()), key=str) == want
    assert len(runs) == S.TRIGGERS and len(want) > 1000 and any(path is None for path, _, _ in want)
