import random
from itertools import combinations

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import near_copies as N
from tests.llm.test_pipeline import rows_of


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(docs):
    """Indices of the rows that stay, by comparing all pairs."""
    sets, root = [shingle_set(text) for _, text in docs], list(range(len(docs)))
    for a, b in combinations(range(len(docs)), 2):
        if similar(sets[a], sets[b]) and root[a] != root[b]:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    least = {}
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)):
        least.setdefault(root[i], i)
    return set(least.values())


def groups(docs, similarity=0.8):
    """The component of each row, by comparing all pairs."""
    sets, root = [shingle_set(text) for _, text in docs], list(range(len(docs)))
    for a, b in combinations(range(len(docs)), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    return root


def test_kept_rows_against_all_pairs(spark):
    rng = random.Random(3)
    docs = [(i, text) for i, text in enumerate([None, "", " \n", "one", "One", "two words"])]
    for k in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 5, 9, 40, 120, 300)))]
        for _ in range(rng.randrange(2, 9)):
            docs.append((len(docs), " ".join(words)))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    footer = " ".join(f"f{k}" for k in range(30))
    docs += [(2000 + k, f"{footer} {' '.join(f'g{k}x{j}' for j in range(k))}") for k in range(20)]
    docs = [(i, f"{t} {n}" if t and n % 7 == 0 else t) for n, (i, t) in enumerate(docs)]
    found = N.near_copies(spark.createDataFrame([(n, *d) for n, d in enumerate(docs)], "n int, doc_id long, text string"))
    kept, root, want = {r["n"] for r in found.where("kept").collect()}, groups(docs), brute_kept(docs)
    assert found.count() == len(docs)
    assert {root[n] for n in kept} == set(root)  # no group is lost, so no link is wrong
    assert want <= kept and len(docs) - len(kept) >= 0.95 * (len(docs) - len(want)) > 50


@pytest.mark.parametrize("share,least", [(0.8, 0.9), (0.9, 0.98)])
def test_recall_of_pairs(spark, share, least):
    rng = random.Random(11)
    docs = []
    for k in range(400):  # pairs of a similarity of just over ``share``: a run of new words at the end
        words = [f"{k}w{j}" for j in range(200)]
        changed = int(196 * (1 - share) / (1 + share))
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 200 - changed] + [f"{k}x{rng.random()}" for _ in range(changed)]))]
    assert all(share <= len(a & b) / len(a | b) < share + 0.02 for a, b in ((shingle_set(docs[2 * k][1]), shingle_set(docs[2 * k + 1][1])) for k in range(0, 400, 40)))
    found = N.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).where("NOT kept").select("doc_id").collect()
    assert {r[0] % 2 for r in found} == {1} and len(found) >= least * 400


def test_parities_never_rule_out_what_is_similar(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**64, n, dtype="u8")
    rows, apart = [], []
    for n in (0, 1, 63, 64, 65, 128, 129, 1000, 5000):
        for new in (0, 1, n // 10, n // 4, n):
            base = draw(n)
            a, b = np.unique(base), np.unique(np.concatenate([base[: n - new // 2], draw(new)]))
            rows.append((len(rows), N.parities(a).tolist(), N.parities(b).tolist()))
            apart.append(len(np.setxor1d(a, b)))
    assert all(len(r[1]) & (len(r[1]) - 1) == 0 for r in rows)
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    got = {r[0]: (r[1], r[2]) for r in df.select("n", N.fewest_apart("a", "b"), N.fewest_apart("b", "a")).collect()}
    for n, d in enumerate(apart):
        assert got[n][0] == got[n][1] <= d
    for n in (100, 1000, 5000):  # a similarity of 0.6 is told from 0.8
        shared, own = draw(n * 3 // 4), n // 4
        pair = [N.parities(np.unique(np.concatenate([shared, draw(own)]))).tolist() for _ in range(2)]
        assert spark.createDataFrame([pair], "a array<long>, b array<long>").select(N.fewest_apart("a", "b")).first()[0] > 0.2 / 1.8 * 2 * n


def test_similar_texts_in_different_groups_are_apart(spark):
    docs = [(1, " ".join(f"w{k}" for k in range(30))), (2, " ".join([*(f"w{k}" for k in range(26)), "x", "y", "z", "t"]))]
    assert N.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).where("kept").count() == 2


def test_large_group_of_copies(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(words)))
    found = N.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = {r[0] for r in found.where("kept").select("doc_id").collect()}
    assert kept >= {docs[i][0] for i in brute_kept(docs)} and len(kept) <= 5


def test_rows_and_not_ids_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = [(1, text), (1, text + " end"), (1, "another text"), (None, text + " more"), (None, "alone")]
    found = N.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).where("kept")
    assert sorted(r["text"] in ("another text", "alone") for r in found.collect()) == [False, True, True]


def test_stage_of_the_pipeline_against_all_pairs(spark):
    docs = P.exact(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "")
    rows = rows_of(docs)
    want, kept = brute_kept([(r[0], r[1]) for r in rows]), rows_of(P.near(spark, docs, ""))
    assert len(want) < len(rows) and kept == [r for i, r in enumerate(rows) if i in want]
    first = docs.where(F.col("doc_id").isin(2, 56))
    assert [r[0] for r in rows_of(P.near(spark, first, ""))] == [2]
