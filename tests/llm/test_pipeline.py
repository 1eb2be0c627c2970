import random
import re
from itertools import combinations

import corpus_pipeline as P
from tests.llm.test_repeats_and_simhash import brute
from tests.llm.test_tokens_and_packing import check_packing


def rows_of(df):
    return [tuple(r) for r in df.orderBy("doc_id").collect()]


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have few toxic documents to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        kept[name] = (docs, docs := spark.read.parquet(str(tmp_path / str(k))))
        if name != "packing":
            assert docs.columns == columns

    before, after = (rows_of(x) for x in kept["toxicity"])
    gone = {r[0] for r in before} - {r[0] for r in after}
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    assert set(after) <= set(before) and sum(labels.get(i, 1) for i in gone) >= 0.9 * len(gone)
    assert sum(labels.get(r[0], 0) for r in after) <= 2

    before, after = (rows_of(x) for x in kept["exact dedup"])
    first = {}
    for r in before:
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or ""), r)
    assert after == sorted(first.values())

    before, after = (rows_of(x) for x in kept["near dedup"])
    shingles = [set(zip(*(r[1].lower().split()[k:] for k in range(5)), strict=False)) or {(r[1].lower(),)} for r in before]
    root = list(range(len(before)))
    for a, b in combinations(root[:], 2):
        if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
            root = [root[a] if r == root[b] else r for r in root]
    first = {r: i for i, r in reversed(list(enumerate(root)))}
    assert after == [before[i] for i in sorted(first.values())] and len(after) < len(before)

    before, after = (rows_of(x) for x in kept["repeated passages"])
    want = brute([(r[0], r[1]) for r in before], 100)
    assert [(r[0], r[1], r[4]) for r in after] == [(i, t := w[3].decode(errors="ignore"), len(t)) for i, w in want.items()]

    assert check_packing(kept["packing"][1].collect(), 2048) >= 1
    assert {r[0] for r in kept["packing"][1].select("doc_id").collect()} == {r[0] for r in after}


def test_run_gives_the_same_documents(spark, sf_dir):
    once, twice = (sorted(tuple(r) for r in P.run(spark, sf_dir).collect()) for _ in range(2))
    assert once == twice and once


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_stages_with_odd_rows(spark, sf_dir):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40_000))
    rows = [(1, text), (1, text), (2, text + " more"), (3, text.replace(" ", "\n")), (3, "other words here"), (None, text), (None, None), (4, None), (5, ""), (6, " \t "), (7, long), (8, long[:5000] + " end"), (9, "short")]
    docs = spark.createDataFrame([(i, t, "xx", None, 0, True, 0.5, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id int")
    left = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(P.COLUMNS)
        left[name] = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert left["toxicity"] == sorted((str(i), t or "") for i, t in rows)
    # one of each text: the empty ones are 4 (null counts as empty), 5 or 6 of the same kind as white space is one space
    assert [i for i, _ in left["exact dedup"]] == ["1", "2", "3", "4", "6", "7", "8", "9"]
    assert [i for i, _ in left["near dedup"]] == ["1", "3", "4", "7", "8", "9"]
    by = dict(left["repeated passages"])
    assert [i for i, _ in left["repeated passages"]] == ["1", "3", "4", "7", "8", "9"]
    assert by["1"] == text and by["7"] == long and len(by["8"]) < 100 and by["4"] == ""
    packed = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert check_packing(packed, 2048) >= 1 and {r["doc_id"] for r in packed} == {1, 3, 4, 7, 8, 9}
