import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup as E
from tessella.llm import url_trie as U
from tessella.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    same(connect(sf_dir), ORACLE_SQL[name], QUERIES[name](spark, sf_dir))


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    out = []
    for i, t in rows:
        group = [j for j, u in rows if norm(u) == norm(t)]
        known = [j for j in group if j is not None]
        out.append((i, min(known) if known else None, len(group)))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (1, None), (2, ""), (4, "ü"), (4, "ü"), (6, "a\u00a0b"), (7, "x" * 300_000), (8, "x" * 300_000 + " ")]


@pytest.mark.parametrize("share", [1, 1024])
def test_dedup_of_odd_rows(spark, share):
    df = spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, kept string")
    got = E.exact_dedup(df, hot_share=share, salts=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute_dedup(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_hot_text_is_dealt_out_and_whole(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (2, 100):
        got = E.exact_dedup(df, hot_share=share, salts=8).groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
        assert {tuple(r) for r in got.where("n > 1").collect()} == {(1, 2000, 2000, 1)} and got.count() == 1001


@pytest.mark.parametrize("own", [7, None])
def test_hot_text_of_one_repeated_id_is_dealt_out(spark, own):
    rows = [(own, "same", k) for k in range(600)] + [(1, "same", k) for k in range(3)] + [(k, f"own {k}", k) for k in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(12)
    found = E.exact_dedup(df, hot_share=4, salts=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be put together again
    try:
        sizes = [r["c"] for r in found.where("text = 'same'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = found.collect()
    assert len(sizes) > 1 and max(sizes) < 600
    assert sorted(r["n"] for r in got) == sorted(r[2] for r in rows)
    assert {(r["keep_id"], r["group_size"]) for r in got if r["text"] == "same"} == {(1, 603)}
    assert [r["doc_id"] for r in got if r["kept"] and r["text"] == "same"] == [1] and sum(r["kept"] for r in got) == 11


def test_hot_text_without_ids_keeps_one_row(spark):
    df = spark.createDataFrame([(None, "same")] * 50 + [(k, f"own {k}") for k in range(5)], "doc_id long, text string").repartition(4)
    got = E.exact_dedup(df, hot_share=4, salts=8).where("text = 'same'").collect()
    assert sum(r["kept"] for r in got) == 1 and {(r["keep_id"], r["group_size"]) for r in got} == {(None, 50)}


def test_dedup_needs_one_exchange_of_texts_and_no_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    plan = E.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Pandas" not in plan
    window = plan[: plan.index("rangepartitioning")]
    assert "hashpartitioning" not in window


def test_dedup_of_nothing(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def judge(spark, urls, **kw):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, URL_RULES, **kw).orderBy("page_id").collect()]


def test_urls(spark):
    got = judge(spark, ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/123", "http://notexample.org/es/", "http://a.com/de", "http://a.com/de/", "http://a.com/fr/1", None, "nothing", "http://x.net/#a", "http://org", "x://y.org/a://b.com/de/", "http://org:80/", "http://.org/"])
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/123", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("a.com", "/de", None, "allow"),
        ("a.com", "/de/", "com/de/", "block"),
        ("a.com", "/fr/1", "com/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.net", "/", None, "allow"),
        ("org", "", None, "allow"),
        ("y.org", "/a://b.com/de/", "org/", "allow"),
        ("org:80", "/", None, "allow"),
        (".org", "/", "org/", "allow"),
    ]
    assert judge(spark, ["http://x.net/"], default="block")[0][3] == "block"
    assert judge(spark, []) == []


def test_trie_against_all_rules():
    import random

    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "ab", ""])
    for _ in range(500):
        rules = [U.Rule(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "/" + "/".join(part() for _ in range(rng.randint(1, 3)))) for _ in range(6)]
        rules = list({(r.host, r.path): r for r in rules}.values())
        host, path = ".".join(rng.choice("ab") for _ in range(3)), "/" + "/".join(part() for _ in range(3))
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        got = U.match(U.build_trie(rules), host, path)
        assert (got is None) == (not fit)
        if fit:
            assert len(got[0]) == max(len(r.host + r.path) for r in fit)
            assert got[0] in {r.host + r.path for r in fit}
