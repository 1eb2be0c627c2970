import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality as Q
from tessella.llm import toxicity as X
from tessella.llm.frames import held_out, labelled_sample
from tessella.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name,label,least,default", [("op1_toxicity", "toxic", 0.95, 0), ("op5_quality", "quality", 0.97, 1)])
def test_held_out_accuracy(spark, name, label, least, default):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    n, right, usual = rows.where("held_out").agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label)), F.count_if(F.col(label) == default)).first()
    assert n > 50 and right / n >= least and right > usual


@pytest.mark.parametrize("module,score", [(X, X.score_toxicity), (Q, Q.score_quality)])
def test_odd_rows(spark, module, score):
    docs = [(i, "fine words here" if i % 2 else "awful awful!! stuff", "x") for i in range(80)] + [(100, None, "x"), (101, "", "x"), (102, "word " * 200_000, "x"), (3, "fine words here", "x"), (None, "fine words here", "x")]
    labels = [(i, i % 2, 1 - i % 2) for i in range(80)] + [(1, None, None), (None, 1, 1), (5, 7, 7), (999, 1, 1)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, LABELS)
    rows = score(df, known, F.lit(True)).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["score"] == by[101]["score"]
    assert by[3]["score"] == by[None]["score"] and by[3]["predicted"] != by[2]["predicted"]
    assert score(df.limit(0), known, F.lit(True)).collect() == []
    assert len(score(df, known.limit(0), F.lit(True)).collect()) == len(docs)  # no labels: the bias alone


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(400)], LABELS)
    seen = {t for t, _ in labelled_sample(docs, labels, "toxic", ~held_out("doc_id", 4, 2), 10_000, 100)}
    out = {f"text {r[0]}" for r in docs.where(held_out("doc_id", 4, 2)).collect()}
    assert not seen & out and len(seen) + len(out) == 400
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 50, 100)) == 50
    first = labelled_sample(docs, labels, "toxic", F.lit(True), 50, 100)
    assert first == labelled_sample(docs.repartition(7), labels.repartition(5), "toxic", F.lit(True), 50, 100)


def test_counterfactual_term_takes_weight_from_group_mentions():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    sample = []
    for i in range(400):
        toxic = i % 2
        text = rng.choices(words, k=8) + (["idiot"] if toxic and rng.random() < 0.6 else [])
        # groups named in toxic texts more often than in others: a false lead
        text += ["muslims"] if rng.random() < (0.8 if toxic else 0.1) else ["women"] if rng.random() < 0.3 else []
        sample.append((" ".join(text), toxic))

    def gap(strength):
        s = X.Settings(counterfactual=strength, l1=1e-4)
        w, b = X.train_toxicity(sample, s)
        logit = lambda t: b + w[X.features(sorted(X.words_of(t)), s)[1]].sum()
        return abs(logit("w1 w2 muslims") - logit("w1 w2 women")), logit("w1 idiot") - logit("w1 w2")

    free, bound = gap(0.0), gap(5.0)
    assert bound[0] < free[0] / 3 and bound[1] > 1


def test_swapping_terms():
    rng = random.Random(0)
    own, swapped = X.swap_terms({"the", "women", "men"}, X.IDENTITY_TERMS, rng)
    assert own == {"the", "women", "men"} and "the" in swapped and len(swapped) == 3 and not swapped & {"women", "men"}
    own, swapped = X.swap_terms({"the"}, X.IDENTITY_TERMS, rng)
    assert len(own) == len(swapped) == 2 and own != swapped


def test_hashes_of_parts_do_not_depend_on_their_place():
    from tessella.llm.hashing import Words

    a, b = Words(["", "abab", "é😀", "x" * 70_000]), Words(["ab"])
    word, hashes = a.grams(2)
    ab = b.grams(2)[1][0]
    assert [(w, h == ab) for w, h in zip(word[:4].tolist(), hashes[:4], strict=True)] == [(1, True), (1, False), (1, True), (2, False)]
    assert len(word) == 3 + 1 + 69_999 and len(set(hashes[4:].tolist())) == 1
    long, first = a.prefixes(2)
    assert long.tolist() == [1, 2, 3] and first[0] == ab
    assert Words(["abab"]).whole()[0] == a.whole()[1] and len(Words([]).whole()) == 0


def test_quality_features():
    s = Q.Settings()
    ids, shares = Q._document("a a b".split(), s)
    assert np.isclose(shares.sum(), 1) and 1 in ids  # a word twice running falls in the bucket of repetition
    assert len(Q._document([], s)[0]) == 0


def plain_hash(part, kind):
    """The polynomial hash of a part of a word, in Python's numbers."""
    mask = (1 << 64) - 1
    x = (sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(part)) + kind * 0xC2B2AE3D27D4EB4F) & mask
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
    return x ^ (x >> 32)


def whole_texts(spark, sf_dir):
    return dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def same_scores(got, want):
    assert len(got) == len(want)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9


def test_toxicity_scores_word_by_word(spark, sf_dir):
    """Every whole text again from the weights, a word and a beginning at a time."""
    s, docs, labels = X.Settings(), spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = X.train_toxicity(labelled_sample(docs, labels, "toxic", ~held_out("doc_id", 4, 2), X.MAX_ROWS, X.MAX_CHARS), s)
    known = {}

    def of_word(w):
        if w not in known:
            known[w] = sum(weights[plain_hash(p, k) >> (64 - s.bits)] for p, k in [(w, 0), *((w[:n], n) for n in s.prefixes if len(w) >= n)])
        return known[w]

    want = {i: 1 / (1 + np.exp(-np.clip(bias + sum(map(of_word, set(X.WORD.findall((t or "").lower())))), -40, 40))) for i, t in whole_texts(spark, sf_dir).items()}
    got = QUERIES["op1_toxicity"](spark, sf_dir).collect()
    same_scores(got, want)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_scores_word_by_word(spark, sf_dir):
    s, docs, labels = Q.Settings(), spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    buckets, bias = Q.train_quality(labelled_sample(docs, labels, "quality", ~held_out("doc_id", 3, 1), Q.MAX_ROWS, Q.MAX_CHARS), s)
    known = {}

    def of_word(w):
        if w not in known:
            marked = f"<{w}>"
            parts = [(marked, 0), *((marked[i : i + n], n) for n in s.grams for i in range(len(marked) - n + 1))]
            hashes = [plain_hash(*p) for p in parts]
            known[w] = hashes[0], sum(buckets[h >> (64 - s.bits)] for h in hashes), len(parts)
        return known[w]

    def score(text):
        words = [of_word(w) for w in text.split()]
        pairs = [1 if a[0] == b[0] else ((a[0] * 0x9E3779B97F4A7C15 + b[0] * 0xC2B2AE3D27D4EB4F) % (1 << 64)) >> (64 - s.bits) for a, b in zip(words, words[1:], strict=False)]
        logit = bias + (sum(w[1] for w in words) + sum(buckets[p] for p in pairs)) / max(sum(w[2] for w in words) + len(pairs), 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    want = {i: score(t or "") for i, t in whole_texts(spark, sf_dir).items()}
    got = QUERIES["op5_quality"](spark, sf_dir).collect()
    same_scores(got, want)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
