import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash as H
from tessella.llm import suffix_dedup as S


def brute(docs, length):
    """Bytes, removed, spans and what is left, by looking at every string."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, np.frombuffer(raw, "u1")[~gone].tobytes())
    return out


def made(rng, n, letters="abcdefé"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(6)]
    docs = []
    for i in range(n):
        t, k = rng.choice(base), rng.random()
        if k < 0.4 and t:
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(letters) + t[p + 1 :]
        elif k < 0.6:
            t = t[rng.randint(0, len(t)) :] + rng.choice(base)[: rng.randint(0, 100)]
        elif k < 0.7:
            t = t * 2
        docs.append((i, t))
    return docs


def removed(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(df, **kw).collect()}


@pytest.mark.parametrize("length,gram,most,letters", [(20, 6, 10**9, "abcdefé"), (20, 6, 2, "abcdefé"), (8, 3, 3, "ab"), (12, 12, 10**9, "ab")])
def test_repeats_against_all_strings(spark, length, gram, most, letters):
    docs = made(random.Random(length + most), 60, letters)
    assert removed(spark, docs, length=length, gram=gram, most=most) == brute(docs, length)


@pytest.mark.parametrize("most", [0, 3, 10**9])
def test_keys_of_many_segments_are_split(spark, most):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijk ", k=n))
    shared = [word(40), word(95), word(130), word(260)]
    docs = [(i, word(rng.randint(0, 90)) + rng.choice(shared) + rng.choice(["", "x", word(30)]) + rng.choice(shared) + word(rng.randint(0, 90))) for i in range(120)]
    assert removed(spark, docs, most=most) == brute(docs, 100)


def test_repeats_in_the_corpus(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert removed(spark, docs) == brute(docs, 100)


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=300_000))
    rows = [(1, long, "k"), (1, long, "k"), (2, long[1000:2000], "k"), (None, long[:150], "k"), (3, None, "k"), (4, "", "k"), (5, "short", "k")]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string"), as_text=True).collect()
    assert len(got) == 7 and got[0].__fields__ == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"]
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == 0 and by[1]["kept"] == long  # given twice, it does not repeat itself
    assert by[2]["kept"] == "" and by[2]["n_spans"] == 1 and by[None]["n_removed"] == 150
    assert by[3]["n_bytes"] == by[4]["n_bytes"] == 0 and by[5]["kept"] == "short"
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_of_a_task_that_gathers():
    rng = random.Random(3)
    data = [rng.randbytes(rng.choice([3_000, 200_000, 400_000])) for _ in range(60)]
    batches = (pd.DataFrame({"id": range(k, k + 5), "th": 0, "base": 0, "data": data[k : k + 5]}) for k in range(0, 60, 5))
    tracemalloc.start()
    try:
        for _ in S.gather(4, S.LENGTH, S.GRAM, S.WIDTHS[0])(batches):
            pass
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    S._powers(S._BASES[0], 4 * S.PASS_BYTES)
    assert all(len(x) <= 4 * S.PASS_BYTES for x in S._made.values())  # a very long text leaves nothing behind


def test_cut_characters_are_left_out_of_text(spark):
    docs = [(1, "é" * 20), (2, "xé" + "é" * 19 + "y")]
    got = {r["doc_id"]: r["kept"] for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=9, gram=4, as_text=True).collect()}
    assert set(got[2]) <= set("xéy")


def test_interval_tree_finds_all_maximal_repeats():
    rng = random.Random(2)
    for _ in range(100):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(6)]
        data = np.frombuffer(b"".join(segments), "u1")
        ends = np.cumsum([len(s) for s in segments])
        starts = ends - [len(s) for s in segments]
        got = {}
        for size, places in S.maximal_repeats(data, starts, ends, 4):
            text = data[places[0] : places[0] + size].tobytes()
            assert all(data[p : p + size].tobytes() == text for p in places)
            got[text] = set(places.tolist())
        places = {}
        for a, b in zip(starts, ends, strict=True):
            for i in range(a, b):
                for j in range(i + 4, b + 1):
                    places.setdefault(data[i:j].tobytes(), set()).add(i)
        bound = {p for p in starts.tolist()}
        want = {}
        for text, at in places.items():
            left = {-p - 1 if p in bound else int(data[p - 1]) for p in at}
            right = {-p - 1 if p + len(text) in set(ends.tolist()) else int(data[p + len(text)]) for p in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[text] = at
        assert got == want


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD = [None, "", "  \n", "One", "one TWO", "ÄÖ a\u00a0b  c\td", "a b c a b c a b c", "word " * 40_000]


def test_fingerprints(spark, sf_dir):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [H.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native & (2**64 - 1) == H.fingerprint("a b c")  # one shingle: its hash


def brute_components(prints):
    label = {f: f for f in prints}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    items = sorted(prints)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[root(b)] = root(a)
    return {f: root(f) for f in items}


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for flips in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), flips)))
            fps.add(f ^ sum(1 << b for b in rng.sample(range(32), flips)))
            fps.add(f ^ sum(1 << b for b in rng.sample(range(31, 64), flips)))
    fps |= {0, 2**64 - 1, 2**63, 7 << 61}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    got = {frozenset(r) for r in H.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("low", [True, False])
def test_a_hot_half_is_cut_before_pairs_are_made(spark, low):
    rng = random.Random(8)
    hot, other = 0xDEADBEEF, 0x12345678
    near = [hot, hot ^ 1, hot ^ (1 << 31)]  # halves at one bit's distance are hot as well, in either direction
    rest = {rng.getrandbits(32) for _ in range(300)}
    rest |= {r ^ sum(1 << b for b in rng.sample(range(32), k)) for r in list(rest)[:80] for k in (1, 2, 3)}
    rest |= {other << 16 & 0xFFFFFFFF | rng.getrandbits(16) for _ in range(300)}  # and some share 48 bits
    fps = {half | r << 32 if low else half << 32 | r for half in near for r in rest}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {frozenset(r) for r in H.near_pairs(df, many=40).collect()}
    items = np.array(sorted(fps), "u8")
    apart = np.bitwise_count(items[:, None] ^ items[None, :])
    want = {frozenset((signed(int(items[a])), signed(int(items[b])))) for a, b in zip(*np.nonzero(apart <= 3), strict=True) if a != b}
    assert got == want == {frozenset(r) for r in H.near_pairs(df, many=10**6).collect()}


def test_candidates_of_a_hot_half_do_not_grow_with_its_square(spark):
    rng = random.Random(9)
    counts = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(7 | rng.getrandbits(31) << 32,) for _ in range(n)], "fp long")
        counts.append(H.candidates(df, many=200).count())
        assert counts[-1] < 0.02 * n * n
    assert spark.createDataFrame([], "fp long").count() == H.candidates(spark.createDataFrame([], "fp long")).count() == 0


def test_components_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "One"), (3, docs[3][1])]
    prints = [(i, H.fingerprint(t)) for i, t in docs]
    root = brute_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f"{f:016x}", least[root[f]]) for i, f in prints)
    got = H.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert H.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
