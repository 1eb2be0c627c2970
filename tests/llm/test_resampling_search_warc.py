import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import lexical as L
from tessella.llm import resampling as R
from tessella.llm import warc as A
from tessella.llm.words import word_blocks

TEXTS = ["", None, "One two three", "ÄÖ one-two_TWO two", "x", " .. ", "lorem ipsum dolor " * 400, "one two three " * 9, "one two three " * 9, "日本語 two ten", "a\u00a0b 12 12"]


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_words_do_not_depend_on_blocks(block):
    for text in TEXTS:
        assert [w.decode() for b in word_blocks((text or "").encode(), block) for w in b] == plain_words(text)


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_features_are_runs_of_words(block):
    for text in TEXTS:
        got = [h for _, hashes in R.features((text or "").encode(), 3, block) for h in hashes.tolist()]
        assert Counter(got) == Counter(plain_features(text))


def brute_resample(docs, target, percent, least, buckets):
    source, goal = (Counter(h % buckets for t in texts for h in plain_features(t)) for texts in ([t for _, t in docs], target))
    s, t = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        found = plain_features(text)
        weight = sum(gain[h % buckets] for h in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


def docs_of(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, rank string, score int").repartition(parts)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(4)
    rows = list(enumerate(TEXTS)) + [(None, "one two three"), (3, "a b c d"), (3, "a b c d")] + [(100 + i, " ".join(rng.choices("one two three four five six".split(), k=rng.randint(0, 30)))) for i in range(300)]
    target = ["one two three", None, "four", "four five"]
    got = R.resample(docs_of(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, buckets=50, least_words=3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, target, 30, 3, 50)


def test_resampling_of_repeated_rows_draws_as_many_as_it_should(spark):
    rows = [(7, "same words here")] * 500 + [(i, "other words") for i in range(100)]
    got = R.resample(docs_of(spark, rows), spark.createDataFrame([("same",)], "text string"), percent=50, least_words=1).where("rank IS NOT NULL")
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 301))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert R.resample(docs_of(spark, []), none).count() == 0
    got = R.resample(docs_of(spark, [(1, "a b"), (None, None)]), none, least_words=1, percent=100).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["rank"]) for r in got), key=str) == [(1, 3, 1), (None, 0, None)]


@pytest.mark.parametrize("k", [1, 2, 77, 499, 500])
def test_kth_key(spark, k):
    values = random.Random(k).choices(range(-20, 20), k=500)
    keys = spark.createDataFrame(list(enumerate(values)), "n long, v long").repartition(4).select(F.struct("v", "n").alias("key"))
    assert tuple(R.kth_key(keys, k, pivots=3)) == sorted((v, n) for n, v in enumerate(values))[k - 1]


def test_ranks_go_on_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 9).select(F.struct(F.xxhash64("id").alias("h")).alias("key"))
    got = [r["key"]["h"] for r in R.ranked(rows, "key").orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 5000


def brute_search(docs, items, k):
    held = [(i, Counter(plain_words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * c.total() * n) // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_words(text) if c[t]), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(best, 1)]
    return sorted(out, key=str)


ITEMS = [(1, "one two three"), (2, "one ONE one"), (3, None), (4, ""), (5, "absent"), (5, "lorem one"), (None, "four"), (6, "one two three"), (6, "one two three"), (7, "日本語 ö")]


@pytest.mark.parametrize(("coordinates", "block_items", "k"), [(1, 1024, 20), (8, 2, 3), (4096, 1024, 4)])
def test_search_equals_brute_force(spark, coordinates, block_items, k):
    rng = random.Random(5)
    rows = list(enumerate(TEXTS)) + [(None, "one two"), (3, "one two"), (3, "one two")] + [(100 + i, " ".join(rng.choices("one two three four five six lorem".split(), k=rng.randint(0, 9)))) for i in range(200)]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = L.lexical_search(docs_of(spark, rows), items, k=k, coordinates=coordinates, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, ITEMS, k)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.lexical_search(docs_of(spark, []), items).count() == 0
    assert L.lexical_search(docs_of(spark, [(1, None), (2, "..")]), items).count() == 0
    assert L.lexical_search(docs_of(spark, [(1, "one")]), items.limit(0)).count() == 0


def test_bounds_hold_and_spare_exact_scores():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    docs = [Counter(w.encode() for w in rng.choices(words, k=40)) for _ in range(400)]
    block = L.Block([" ".join(rng.choices(words, k=5)).encode() for _ in range(10)])
    block.weigh(400, [sum(t in d for d in docs) for t in block.vocabulary], 512)
    held = [L.impacts(L.np.fromiter(d.values(), "i8"), 100) for d in docs]
    sketches = L.np.stack([L.sketch(d, x, 512) for d, x in zip(docs, held, strict=True)])
    bounds = block.bounds(sketches)
    for q in range(10):
        for i, d in enumerate(docs):
            at = dict(zip(d, held[i].tolist(), strict=True))
            assert bounds[i, q] >= sum(w * at.get(t, 0) for t, w in zip(block.names[q], block.weights[q], strict=True))
    assert L.rescore(block, L.Best(10, 3), list(range(400)), docs, held, bounds) < 400 * 10 / 4


PAYLOADS = ["", None, "<p>a</p>", "<p>a</p>", "ü" * 30_000, "ü" * 30_000, "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "\n", "\r", "no line " * 40_000, "\r\n\r\n", "x"]
URLS = ["http://a.example/", None, "http://b.example/x y\r\nWARC-Type: x", "", "http://c.example/ü"]


def digest(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def brute_archive(pages, least=0):
    out, taken = [], set()
    for n, (i, p) in enumerate(pages):
        size = len((p or "").encode())
        same = [(j is not None, j or 0, -m, m) for m, (j, q) in enumerate(pages) if (q or "") == (p or "")]
        best = max(same)
        if size < least or best[3] == n:
            out.append((i, size, digest(p), "response", None))
        else:
            out.append((i, size, digest(p), "revisit", pages[best[3]][0]))
        taken.add(n)
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "least"), [(1000, 0), (7, 0), (1 << 18, 0), (1 << 18, 3)])
def test_archive_equals_brute_force(spark, tmp_path, chunk, least):
    pages = [*enumerate(PAYLOADS), (3, "<p>a</p>"), (3, "<p>a</p>"), (None, "<p>a</p>"), (None, "own"), (None, "own"), (9, "other of a repeated id")]
    df = spark.createDataFrame([(i, URLS[n % 5], p, b"k") for n, (i, p) in enumerate(pages)], "page_id long, url string, html string, record binary").repartition(3)
    got = A.archived(df, str(tmp_path / "w"), least, chunk)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_archive(pages, least)


def test_chunks_come_back_in_order_with_running_digests(spark, tmp_path):
    payload = "".join(chr(33 + i % 90) + "\n" * (i % 7 == 0) for i in range(50_000))
    df = spark.createDataFrame([(1, "http://a/", payload), (2, "http://b/", payload[:10])], "page_id long, url string, html string")
    A.write_warc(df, str(tmp_path / "w"), chunk=1000)
    for chunk in (1000, 300, 1 << 20):
        rows = [r for r in A.read_warc(spark, str(tmp_path / "w" / "responses"), chunk).collect() if ":1:" in r["record_id"]]
        assert [r["chunk"] for r in rows] == list(range(len(rows))) and b"".join(r["data"] for r in rows).decode() == payload
        for n, r in enumerate(rows):
            so_far = b"".join(x["data"] for x in rows[: n + 1])
            assert (r["size"], r["digest"]) == (len(so_far), base64.b32encode(hashlib.sha1(so_far).digest()).decode())
            assert len(r["data"]) <= 1000 and r["last"] == (n == len(rows) - 1)
        assert rows[-1]["complete"] and rows[-1]["digest"] == rows[-1]["declared"] == digest(payload)


def test_archives_are_read_whoever_wrote_them(spark, tmp_path):
    """A whole-file check by lengths alone, records of other types, a record that is cut off, and another file after it."""
    body = b"\x00\xff\nWARC/1.0\r\n\r\n\n"
    http = b"HTTP/1.0 200 OK\r\ncontent-length: %d\r\n\r\n%s" % (len(body), body)
    record = lambda kind, content, more=b"": b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, kind, more, len(content), content)
    typed = b"Content-Type: application/http;msgtype=response\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"warcinfo", b"software: x\r\n")) + gzip.compress(record(b"response", http, typed)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"resource", body * 3) + record(b"response", http, typed)[:-14]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record(b"metadata", b"", b"X:\r\n folded\r\n")))
    got = {(r["type"], r["complete"]): bytes(r["data"]) for r in A.read_warc(spark, str(tmp_path)).coalesce(1).collect()}
    assert got[("warcinfo", True)] == b"software: x\r\n" and got[("response", True)] == body
    assert got[("resource", True)] == body * 3 and got[("metadata", True)] == b""
    assert got[("response", False)] == body[:-10] and len(got) == 5


def test_archive_of_an_empty_table(spark, tmp_path):
    assert A.archived(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


def test_written_archives_keep_their_lengths(spark, tmp_path):
    """A plain walk over the bytes: each record is a header, its length in bytes and two line ends."""
    df = spark.createDataFrame([(i, URLS[i % 5], p) for i, p in enumerate(PAYLOADS)], "page_id long, url string, html string").repartition(2)
    A.write_warc(df, str(tmp_path / "w"), chunk=5000)
    kinds = Counter()
    for path in (tmp_path / "w").glob("re*/*.gz"):
        data, at = gzip.decompress(path.read_bytes()), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            lines = [line.split(b": ", 1) for line in head.split(b"\r\n")[1:]]
            assert all(len(x) == 2 for x in lines)
            fields = dict(lines)
            kinds[fields[b"WARC-Type"]] += 1
            at += len(head) + 4 + int(fields[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert kinds[b"revisit"] == 3 and kinds[b"response"] == len(PAYLOADS) - 3 and kinds[b"continuation"] > 50


def test_a_hot_payload_is_one_response(spark, tmp_path):
    rows = [(i, "http://a/", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    got = A.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    assert got.where("record_type = 'response'").count() == 1001 and got.where("refers_to = 2999").count() == 1999
