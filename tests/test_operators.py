import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks as B
from tessella.functions.vectors import cosine, cosine_to, unit
from tessella.operators import duplicates as D
from tessella.operators import retrieval as R
from tessella.operators import text as T
from tessella.operators.components import connected_components
from tessella.streaming import files, monitors


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(300, 200), (201, 200), (400, 400), (None, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200, 300: 200, 400: 400}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = rows.select(cosine(F.col("a"), F.col("b")), unit(F.col("b"))).collect()
    assert got[0][0] == 0 and got[0][1] is None and math.isclose(got[1][0], 1) and got[1][1] == [0.6, 0.8]


def test_cosine_to_one_vector(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "i int, a array<float>")
    got = [r[0] for r in rows.orderBy("i").select(cosine_to([1.0, 0.0])(F.col("a"))).collect()]
    assert math.isclose(got[0], 0.6) and got[1:] == [None, 0.0]


def test_hamming_chain_is_one_cluster_and_leaders_are_not(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0b1111), (3, 0b11111111), (4, 0b1111)], "id long, h long")
    assert {tuple(r) for r in D.hamming_pairs_within(rows, 4).collect()} == {(1, 2), (2, 3), (2, 4)}
    assert set(dict(D.clusters(D.hamming_pairs_within(rows, 4)).collect()).values()) == {1}
    vectors = spark.createDataFrame([(0, 1, [1.0, 0.0], 5), (0, 2, [0.8, 0.6], 9), (0, 3, [0.3, 0.95], 1)], "doc_id long, id long, v array<double>, size int")
    assert [tuple(r) for r in D.leaders(vectors, 0.75).orderBy("id").collect()] == [(0, 1, 1, False), (0, 2, 1, True), (0, 3, 3, True)]


def test_difference_hash_of_a_full_grid(spark):
    pixels = [(r * 9 + c) * (1 if r % 2 else -1) for r in range(8) for c in range(9)]
    rows = spark.createDataFrame([(pixels,)], "p array<int>")
    want = sum(1 << (r * 8 + c) for r in range(1, 8, 2) for c in range(8))
    assert rows.select(D.dhash(F.col("p"), 9, 8)).first()[0] & (2**64 - 1) == want


def hits(spark, rows):
    return spark.createDataFrame(rows, "id long, doc_id long, chunk_type string, score double, rank int, asset_path string")


def test_equal_scores_put_text_first(spark):
    got = R.merged(hits(spark, [(1, 1, "image", 0.5, 1, "a"), (2, 1, "text", 0.5, 1, None)])).orderBy("position").collect()
    assert [r["id"] for r in got] == [2, 1]


def test_guards(spark):
    rows = [(1, 1, "text", 0.9, 1, None), (2, 1, "image", 0.5, 1, "a"), (3, 2, "image", 0.8, 2, "b"), (4, 1, "image", 0.7, 3, "c"), (5, 1, "image", 0.69, 4, "d"), (6, 1, "image", 0.68, 5, "e"), (7, 9, "image", 0.6, 6, "f"), (8, 1, "image", 0.9, 7, "")]
    got = {r["id"]: (r["approved"], r["drop_reason"]) for r in R.guarded(R.merged(hits(spark, rows)), 0.55, 2).collect()}
    # the walk ends at the third that passes, so what comes later has no reason
    assert got == {3: (False, "cross_doc_id_guard"), 4: (True, None), 5: (True, None), 6: (False, None), 7: (False, None), 2: (False, None)}
    low = {r["id"]: r["drop_reason"] for r in R.guarded(R.merged(hits(spark, rows[:2])), 0.55, 2).collect()}
    assert low == {2: "image_score_min"}
    raised = {r["id"]: r["approved"] for r in R.guarded(R.merged(hits(spark, rows[:2]), 0.10), 0.55, 2).collect()}
    assert raised == {2: True}


def test_pages_of_a_short_document_are_both(spark):
    rows = spark.createDataFrame([(1, 8, None), (25, 30, None), (400, None, None), (15, 40, "Sachindex")], "p long, n long, h string")
    got = rows.select(*R.matter(F.col("p"), F.col("n"), F.col("h"))).collect()
    assert [tuple(r)[:2] for r in got] == [(True, True), (False, True), (False, True), (False, True)]
    assert got[0][2] == ["page_in_first_10", "page_in_last_10"] and got[2][2] == ["page_fallback_gte_320"]


@pytest.mark.parametrize("url,base,width", [("http://a/x_r1.5_w520.jpg#f", "http://a/x.jpg", 520), ("http://a/x?w=1&id=1", "http://a/x?id=1", 0), ("http://a/x?h=2", "http://a/x", 0)])
def test_image_urls(spark, url, base, width):
    got = spark.createDataFrame([(url,)], "u string").select(T.normal_image_url(F.col("u")), T.cdn_width(F.col("u"))).first()
    assert tuple(got) == (base, width)


def test_deictic_words_in_any_case(spark):
    rows = spark.createDataFrame([("Was ist DARÜBER bekannt",), ("Darüberhinaus",), ("darin",)], "t string")
    assert [r[0] for r in rows.select(F.col("t").rlike(T.words(T.DEICTIC))).collect()] == [True, False, True]


def test_sliding_quota_counts_only_what_was_allowed():
    got, _ = monitors.sliding([0, 10, 20, 3599, 3601, 3605], [], 2)
    assert [g[0] for g in got] == [True, True, False, False, True, False]
    assert got[2][2] == 3580
    assert [g[1] for g in monitors.sliding(list(range(1000, 1011)), [], 10)[0]] == [*range(9, -1, -1), 0]


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


class Only:
    """Views of one given table of events."""

    def __init__(self, rows):
        self.rows = rows

    def table(self, name):
        assert name == "events"
        return self.rows


def test_streams_decide_like_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 450")
    # time follows the id, as rows of a later file cannot come before those of an earlier one; within a file the order is reversed
    events = events.withColumn("user_id", F.col("user_id") % 5).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 700)).withColumn("s", F.unix_timestamp("ts"))
    for k in range(3):
        part = events.where(f"event_id >= {k * 150} AND event_id < {(k + 1) * 150}")
        part.coalesce(1).sortWithinPartitions(F.desc("event_id")).write.mode("append").parquet(str(tmp_path / "in"))
    schema = events.schema
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # a key's rows come in several batches
    try:
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        changes = run_stream(monitors.stream_changes(stream()), "changes").collect()
        quota = run_stream(monitors.stream_quota(stream().select("user_id", "event_id", "s"), 1), "quota").collect()
        counts = run_stream(monitors.windowed_counts(stream()), "windows", "complete").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = monitors.state_changes(Only(events)).select("user_id", "event_id", "old", "new", "severity").collect()
    assert sorted(map(tuple, changes)) == sorted(map(tuple, want)) and len(want) > 50
    want = monitors.rate_limit_sliding(Only(events), 1).collect()
    assert sorted(map(tuple, quota)) == sorted(map(tuple, want)) and {r["allowed"] for r in want} == {True, False}
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count().collect()
    assert sorted(map(tuple, counts)) == sorted(map(tuple, want))


def test_sliding_quota_against_each_users_history(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.unix_timestamp("ts"))
    users = {}
    for r in events.select("user_id", "s", "event_id").collect():
        users.setdefault(r["user_id"] % 3, []).append((r["s"], r["event_id"]))
    want = set()
    for rows in users.values():
        taken = []
        for now, event in sorted(rows):
            last = [t for t in taken if now - 3600 < t <= now]
            taken += [now] if len(last) < 2 else []
            want.add((event, True, 1 - len(last), 0) if len(last) < 2 else (event, False, 0, max(1, last[0] + 3600 - now)))
    got = monitors.rate_limit_sliding(Only(events.withColumn("user_id", F.col("user_id") % 3))).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_containing_against_all_pairs(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("ab ", k=n))
    texts = [(i, ("same beginning of " if i % 2 else "") + text(rng.randrange(60))) for i in range(80)] + [(80, ""), (81, None), (82, "Äö\U0001f600ü")]
    needles = ["", "a", "ab", "zz", "same beginning of ", "Äö\U0001f600", None] + [t[a : a + rng.randrange(1, 61)] for _, t in texts[:80] for a in (0, 5)]
    got = R.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "id long, body string")).collect()
    want = {(n, i) for n in needles for i, t in texts if n and t and n in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    parts = R.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "id long, body string"), part_chars=900).collect()
    assert {tuple(r) for r in parts} == want and len(parts) == len(want)


def test_blocks_of_unequal_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [0.9, 0.1, 0.0])], "id long, v array<double>")
    assert sorted(map(tuple, D.cosine_pairs_within(rows, 0.9, block=2).collect())) == [(1, 2), (1, 5), (2, 5)]
    assert dict(D.first_match(rows.where("id > 2"), rows.where("id <= 2"), 0.9).collect()) == {5: 1}
    assert dict(D.ordered_store(rows.where("id > 2"), rows.where("id <= 2"), 0.9).collect()) == {3: 3, 4: 4, 5: 1}
    assert D.cosine_pairs_within(rows.limit(0), 0.9).count() == 0


def test_hamming_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(56) for _ in range(40)]
    rows = [(i, base[i % 40] ^ sum(1 << b for b in rng.sample(range(56), rng.randrange(5)))) for i in range(200)]
    for distance in (0, 1, 3, 4, 6):
        got = D.clusters(D.hamming_pairs_within(spark.createDataFrame(rows, "id long, h long"), distance)).collect()
        root = {i: i for i, _ in rows}
        for i, a in rows:
            for j, b in rows:
                if i < j and (a ^ b).bit_count() <= distance and root[i] != root[j]:
                    old = max(root[i], root[j])
                    root |= {k: min(root[i], root[j]) for k, r in root.items() if r == old}
        alone = {i for i in root if sum(r == root[i] for r in root.values()) == 1}
        assert dict(map(tuple, got)) == {i: r for i, r in root.items() if i not in alone}


def test_only_new_files_are_taken(spark, tmp_path):
    src, out, seen = (str(tmp_path / x) for x in ("src", "out", "seen"))
    spark.range(5).write.parquet(src)
    files.take_new(spark, src, "id bigint", out, seen)
    files.take_new(spark, src, "id bigint", out, seen)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    files.take_new(spark, src, "id bigint", out, seen)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(8))


def saved_one_by_one(new, store, least):
    """The loop: each in turn is like the first stored thing, or saved."""
    like = lambda a, b: bool(a and b and any(a) and any(b)) and round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6) >= least
    held, contents, out = sorted(store.items()), {}, {}
    for i, (v, content) in sorted(new.items()):
        if content is not None and content in contents:
            out[i] = contents[content]
            continue
        out[i] = next((j for j, w in held if like(v, w)), i)
        if out[i] == i:
            held.append((i, v))
        if content is not None:
            contents[content] = out[i]
    return out


@pytest.mark.parametrize(("seed", "least", "empty"), [(1, 0.98, False), (2, 0.9, True)])
def test_store_in_order_equals_the_loop(spark, seed, least, empty):
    rng = random.Random(seed)
    chain = [[math.cos(a / 9), math.sin(a / 9), 0.0] for a in rng.sample(range(57), 40)]  # each is like its neighbours
    noise = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)] + [None, [0.0] * 3]
    vectors = rng.sample(chain + noise, 102)
    ids = rng.sample(range(1000), 102)
    new = {i: (v, rng.choice([None, "a", "b", f"own {i}"])) for i, v in zip(ids, vectors, strict=True)}
    store = {2000 + i: [rng.gauss(0, 1) for _ in range(3)] for i in range(6)}
    schema = "id long, v array<double>, content string"
    rows = spark.createDataFrame([(i, v, c) for i, (v, c) in new.items()], schema).repartition(5)
    held = spark.createDataFrame([(i, v) for i, v in store.items()], "id long, v array<double>")
    store, held = ({}, held.limit(0)) if empty else (store, held)
    assert dict(map(tuple, D.ordered_store(rows, held, least, "content").collect())) == saved_one_by_one(new, store, least)
    plain = {i: (v, None) for i, (v, _) in new.items()}
    assert dict(map(tuple, D.ordered_store(rows, held, least).collect())) == saved_one_by_one(plain, store, least)
    assert D.ordered_store(rows.limit(0), held, 0.9).count() == 0


def test_first_independent_set_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(0, 40)] * 2
    taken = {r["id"] for r in D.first_independent(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert taken == set(range(0, 40, 2))


def test_copies_and_long_walks_stay_small(spark, monkeypatch):
    """Copies of a vector make no pairs, and the partitions of what follows do not add up over the rounds."""
    made, pairs = [], D.cosine_pairs_within
    monkeypatch.setattr(D, "cosine_pairs_within", lambda *a: made.append(p := pairs(*a)) or p)
    kinds = [[1.0, 0.0], [0.96, 0.28], [0.0, 1.0], [0.0, 0.0]]
    new = spark.createDataFrame([(i, kinds[i % 4]) for i in range(100, 300)], "id long, v array<double>")
    held = spark.createDataFrame([(i, [0.0, 2.0]) for i in range(50)], "id long, v array<double>")
    got = dict(map(tuple, D.ordered_store(new, held, 0.9).collect()))
    assert got == {i: (100, 100, 0, i)[i % 4] for i in range(100, 300)}
    assert made[0].count() == 1

    kept, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: kept.append(c := cut(df)) or c)
    taken = {r["id"] for r in D.first_independent(spark.createDataFrame([(i, i + 1) for i in range(24)], "a long, b long")).collect()}
    assert taken == set(range(0, 25, 2))
    assert max(df.rdd.getNumPartitions() for df in kept) <= 16


def test_blocks_grow_with_the_rows_and_hold_floats_as_floats(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((40_000, 2)).astype("f4")
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(40_000), "v": m.tolist()}), "id long, v array<float>").withColumn("flag", F.lit(False))
    blocks, count = B.dealt(rows)
    assert count == 32 and blocks.selectExpr("sum(length(m)) AS n").first()["n"] == 40_000 * 8


def test_pairs_by_strips_equal_brute_force(spark):
    """Repeated ids and vectors, vectors of other lengths, without direction or finite numbers, and cosines at the border."""
    rng = np.random.default_rng(4)
    kinds = rng.standard_normal((60, 6)).round(1)
    rows = [(int(i), [float(x) for x in kinds[rng.integers(60)][: rng.integers(4, 7)]]) for i in rng.integers(0, 1500, 1700)] + [(2000, [0.0] * 6), (2001, [float("nan")] * 6), (2002, [3e38] * 6), (2003, [0.6, 0.8]), (2004, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    held = [(i, np.pad(np.float32(v).astype("f8"), (0, 6 - len(v)))) for i, v in rows]
    m = np.stack([v for _, v in held])
    with np.errstate(invalid="ignore"):
        size = np.linalg.norm(m, axis=1)
        cos = np.round(np.divide(m @ m.T, np.outer(size, size), out=np.zeros((len(m), len(m))), where=np.outer(size, size) > 0), 6)
        for least in (0.6, 0.99, -0.2):
            want = {(held[i][0], held[j][0]) for i, j in zip(*np.nonzero(cos >= least), strict=True) if held[i][0] < held[j][0]}
            for block in (None, 300):
                got = [tuple(r) for r in D.cosine_pairs_within(df, least, block).collect()]
                assert len(got) == len(set(got)) and set(got) == want


def test_blocks_that_meet_are_not_gathered_on_the_driver(spark, monkeypatch):
    """The first side is repeated for each block, which Spark does not count: it would broadcast many times what it takes it for."""
    plans = []
    monkeypatch.setattr(B, "cut", lambda df: df.collect() and plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(60)], "id long, v array<double>")
    alike = {(i, j) for i in range(60) for j in range(i) if math.cos(i - j) >= 0.99}
    pairs = B.asked_of_all(rows, rows.withColumn("flag", F.lit(False)), lambda a, b, _, at: pd.DataFrame({"id": a[at[0]], "id2": b[at[1]]}), "id long, id2 long", 8, B.alike(0.99))
    assert {(r["id"], r["id2"]) for r in pairs.collect() if r["id"] > r["id2"]} == alike
    assert {(r["id2"], r["id"]) for r in D.cosine_pairs_within(rows, 0.99, 8).collect()} == alike
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in plans)
