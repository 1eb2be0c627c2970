"""Removing repeated passages: windows meet under anchors; suffix arrays with interval trees give the repeats of each anchor."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import small_batches
from tessella.plans.lineage import cut

#: Length in bytes of the strings that count as repeats.
LENGTH = 100
#: Bytes hashed for an anchor. Every window of LENGTH bytes holds LENGTH - GRAM + 1 of them and takes the smallest.
GRAM = 32
#: Bytes of text looked at in one numpy pass, and anchors gathered before they are sent.
PASS_BYTES, SENT = 500_000, 400_000
#: Bytes of segments in one suffix array.
ARRAY_BYTES = 500_000
#: Different segments of one anchor that one suffix array takes. Beyond, the anchor is split by more of the bytes around it.
MANY = 1000
#: Windows under one key, round by round: all that an anchor can have, then fewer with more bytes in common. The last round
#: has one window to a key, all of whose bytes are in common, so nothing is left to split.
WIDTHS = (LENGTH - GRAM + 1, 9, 1)
#: Bytes of text whose anchors make a bucket, which a worker holds, and those of a partition, which is read bucket by bucket.
BUCKET_BYTES, PART_BYTES = 32 << 20, 256 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MAX = np.iinfo("i8").max


_made: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, from 0 to ``size`` at least. One array a base is kept, and none for a very long text."""
    made = _made.get(base, ())
    if len(made) <= size:
        with np.errstate(over="ignore"):
            made = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(1 << max(1, size).bit_length(), base, "u8")]))
        if size <= 2 * PASS_BYTES:
            _made[base] = made
    return made


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all bits; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Polynomial hashes of any stretch of a byte string, modulo 2**64, mixed; they do not depend on the place."""

    def __init__(self, data: np.ndarray, base: int):
        self.inverse = _powers(pow(base, -1, 1 << 64), len(data))
        self.total = np.zeros(len(data) + 1, "u8")
        with np.errstate(over="ignore"):
            np.multiply(_powers(base, len(data))[: len(data)], data + np.uint64(1), out=self.total[1:])
        np.cumsum(self.total, out=self.total)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.total[stop] - self.total[start]) * self.inverse[start])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int, width: int) -> tuple[np.ndarray, ...]:
    """Of several documents laid end to end (``ends``): per run of windows its key, first and last window, segment hash.

    A window's anchor is the gram of the smallest hash in it, the first of equals. That depends on nothing but the window's
    bytes, so equal windows have equal anchors at equal distances. Neighbouring windows with one anchor and distances in one
    range of ``width`` form a run; the bytes under it are its segment. Its key hashes the bytes that all windows with such
    distances share: the gram itself if ``width`` is all there is, the whole window if it is 1.
    """
    none = np.empty(0, "i8")
    empty = none.astype("u8"), none, none, none.astype("u8")
    n = len(data)
    if n < length:
        return empty
    roll = _Rolling(data, _BASES[0])
    place = np.arange(n - gram + 1)
    least = (roll.of(place, place + gram) & np.uint64(0xFFFFFFFF00000000)) | place.view("u8")
    del place
    reach, span = length - gram + 1, 1
    while span < reach:  # minimum over `span` grams, doubled until it covers the window
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    window = np.arange(len(least))
    doc_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    window = window[window + length <= doc_end]
    if not len(window):
        return empty
    at = (least[window] & np.uint64(0xFFFFFFFF)).astype("i8")
    del least, doc_end
    part = (at - window) // width
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1) | (part[1:] != part[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    lo, hi, anchor, part = window[first], window[last], at[first], part[first]
    del window, at
    core = anchor - part * width
    core_end = anchor - np.minimum(part * width + width - 1, length - gram) + length
    with np.errstate(over="ignore"):
        key = roll.of(core, core_end) ^ _mix(part.astype("u8") * np.uint64(width))
        whole = _Rolling(data, _BASES[1]).of(lo, hi + length) ^ _mix(roll.of(lo, hi + length) + (anchor - lo).astype("u8") * np.uint64(1009))
    return key, lo, hi, whole


def _firsts(h: np.ndarray, s: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, segment, document and place, and which rows begin a group of equal segments there."""
    order = np.lexsort((lo, doc, s, h))
    a, b = h[order], s[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each document, with those that touch or overlap made one; ``doc`` is an index."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(doc * wide + stop)
    new = np.flatnonzero(np.concatenate([[True], doc[1:] * wide + start[1:] > reach[:-1]]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], start[new], reach[last] - doc[new] * wide


_PACKED = "bucket int, blob binary, id long, th int, s int, e int"
_FOUND = "id long, th int, base int, s int, e int, h long, many boolean"


def _found(ids: np.ndarray, th: np.ndarray, s: np.ndarray, e: np.ndarray, base: np.ndarray | None = None, h: np.ndarray | None = None, many: np.ndarray | None = None) -> pd.DataFrame:
    """Stretches of documents: to be removed if ``h`` is -1, else still to be compared under that key."""
    n = len(ids)
    blank = lambda x, kind, value: np.full(n, value, kind) if x is None else x.astype(kind)
    return pd.DataFrame({"id": ids.astype("i8"), "th": th.astype("i4"), "base": blank(base, "i4", 0), "s": s.astype("i4"), "e": e.astype("i4"), "h": blank(h, "i8", -1), "many": blank(many, bool, False)})


def _pack(owners: tuple[np.ndarray, ...], doc: np.ndarray, h: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Runs of one bucket, in the order of documents and places, as bytes: each document once, then column after column."""
    used, counts = np.unique(doc, return_counts=True)
    ids, th, base = (x[used] for x in owners)
    head = np.array([len(used), len(doc)], "<u4")
    parts = (head, ids.astype("<i8"), th.astype("<i4"), base.astype("<i4"), counts.astype("<u4"), h.astype("<u8"), s.astype("<u8"), lo.astype("<u4"), (hi - lo).astype("<u2"))
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    at = 8
    docs, n = np.frombuffer(blob, "<u4", 2).tolist()

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    ids, th, base, counts, h, s, lo, more = take("<i8", docs), take("<i4", docs), take("<i4", docs), take("<u4", docs), take("<u8", n), take("<u8", n), take("<u4", n), take("<u2", n)
    lo = lo.astype("i8")
    return *(np.repeat(x, counts) for x in (ids, th, base)), h, s, lo, lo + more


def gather(buckets: int, length: int, gram: int, width: int):
    """For ``mapInPandas`` over (id, th, base, data): packed runs by bucket, and stretches that repeat within the task's rows.

    Of equal segments in one task only the first can be the first of all; the others are removed at once. So a
    passage that many documents share is sent once from each task, however often it occurs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        owners: list[tuple[int, int, int]] = []
        texts: list[bytes] = []
        count = 0

        def look() -> int:
            sizes = np.fromiter(map(len, texts), "i8", len(texts))
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(texts), "u1")
            before = len(owners) - len(texts)
            texts.clear()
            h, lo, hi, s = anchors(data, ends, length, gram, width)
            doc = np.searchsorted(ends, lo, "right")
            start = ends[doc] - sizes[doc] if len(doc) else doc
            held.append((doc + before, h, s, lo - start, hi - start))
            return len(doc)

        def send() -> Iterator[pd.DataFrame]:
            doc, h, s, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            ids, th, base = (np.array(x, "i8") for x in zip(*owners, strict=True))
            lo, hi = lo + base[doc], hi + base[doc]
            by = np.lexsort((base, th, ids))
            fresh = np.concatenate([[True], (ids[by][1:] != ids[by][:-1]) | (th[by][1:] != th[by][:-1]) | (base[by][1:] != base[by][:-1])])
            rank = np.empty(len(ids), "i8")
            rank[by] = np.cumsum(fresh) - 1  # repeated rows are one document
            own = tuple(x[by[fresh]] for x in (ids, th, base))
            doc = rank[doc]
            order, new = _firsts(h, s, doc, lo)
            doc, h, s, lo, hi = (x[order] for x in (doc, h, s, lo, hi))
            same = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])]) if len(new) else new
            d, a, b = _merged(doc[~new & ~same], lo[~new & ~same], hi[~new & ~same] + length)
            gone = pd.DataFrame({"id": own[0][d], "th": own[1][d], "s": a, "e": b})
            doc, h, s, lo, hi = (x[new] for x in (doc, h, s, lo, hi))
            # keys of the first round are the smallest hashes around, so their upper bits alone would fill the first buckets
            bucket = ((_mix(h) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")
            by = np.lexsort((lo, doc, bucket))
            edges = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1], [True]])) if len(by) else []
            rows = [(bucket[p[0]], _pack(own, *(x[p] for x in (doc, h, s, lo, hi)))) for p in (by[i:j] for i, j in zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["bucket", "blob"]).assign(id=0, th=0, s=0, e=0)
            # a stretch found here goes the way of a bucket too, dealt by its document
            yield gone.assign(bucket=gone["id"] % buckets, blob=None)[["bucket", "blob", "id", "th", "s", "e"]]

        pending = 0
        for batch in batches:
            for *owner, data in zip(*(batch[c].tolist() for c in ("id", "th", "base", "data")), strict=True):
                owners.append(tuple(owner))
                texts.append(data)
                pending += len(data)
                if pending >= PASS_BYTES:
                    count += look()
                    pending = 0
            if texts:
                count += look()
                pending = 0
            if count >= SENT:
                yield from send()
                owners.clear()
                count = 0
        if held:
            yield from send()

    return run


def settle(length: int, most: int):
    """For ``mapInPandas`` over rows sorted by bucket: of equal segments of a key, all but the first are removed.

    Equal segments are one leaf of the key's suffix array, so each goes on once. A key with one segment is done; the segments
    of the others are left to compare, and marked if they are more than ``most``.
    """

    def settled(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        ids, th, base, h, s, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        again = h[order][1:] == h[order][:-1]
        often = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
        ids, th, base, h, s, lo, hi = (x[often] for x in (ids, th, base, h, s, lo, hi))
        order = np.lexsort((lo, th, ids, s, h))
        ids, th, base, h, s, lo, hi = (x[order] for x in (ids, th, base, h, s, lo, hi))
        if not len(h):
            return
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], s[1:] != s[:-1]])
        same = np.concatenate([[False], ~new[1:] & (ids[1:] == ids[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1])])
        gone = ~new & ~same
        if gone.any():
            yield _found(ids[gone], th[gone], lo[gone], hi[gone] + length)
        key = np.cumsum(new_h) - 1
        kinds = np.bincount(key, new)[key]
        open_ = new & (kinds > 1)
        if open_.any():
            yield _found(ids[open_], th[open_], lo[open_], hi[open_] + length, base[open_], h[open_] & np.uint64(_MAX), kinds[open_] > most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = -1, []
        for batch in batches:
            local = batch[batch["blob"].isna()]
            if len(local):
                yield _found(*(local[c].to_numpy() for c in ("id", "th", "s", "e")))
            for k, blob in zip(batch["bucket"].tolist(), batch["blob"].tolist(), strict=True):
                if blob is None:
                    continue
                if k != at and held:
                    yield from settled(held)
                    held = []
                at = k
                held.append(_unpack(blob))
        if held:
            yield from settled(held)

    return run


def _ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Ranks of all suffixes by their first 2**k bytes, for the largest 2**k up to ``length``, by doubling."""
    wide = np.concatenate([data, np.zeros(8, "u1")]).astype("u8")
    depth = min(8, 1 << length.bit_length() - 1)
    key = np.zeros(len(data), "u8")
    for k in range(depth):
        key = key << np.uint64(8) | wide[k : k + len(data)]
    _, rank = np.unique(key, return_inverse=True)
    while depth * 2 <= length:
        after = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, len(rank)), rank.dtype)])[: len(rank)]
        _, rank = np.unique(rank.astype("i8") * (len(data) + 2) + after, return_inverse=True)
        depth *= 2
    return rank, depth


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, places)`` of every maximal repeat of ``length`` bytes or more in segments laid end to end, with all its places.

    The enhanced suffix array holds the places where a window of ``length`` bytes fits into its segment, sorted, with
    the lengths that neighbours share. A stack walks it and closes common-prefix intervals: an interval is right-maximal
    as its members share no more than its length; it is put out if the bytes before its members differ, a segment's
    begin differing from everything. Runs whose members all have one byte before them hold no maximal repeat and are
    passed over.
    """
    sizes = ends - starts
    fit = np.maximum(sizes - length + 1, 0)
    base = np.repeat(starts, fit)
    at = base + np.arange(len(base)) - np.repeat(np.cumsum(fit) - fit, fit)
    stop = np.repeat(ends, fit)
    if len(at) < 2:
        return
    rank, depth = _ranks(data, length)
    second = rank[at + length - depth].astype("i8")
    order = np.lexsort((second, rank[at]))
    at, base, stop, second = at[order], base[order], stop[order], second[order]
    first = rank[at]
    equal = np.concatenate([[False], (first[1:] == first[:-1]) & (second[1:] == second[:-1]), [False]])
    before = np.where(at == base, -1, data[np.maximum(at - 1, 0)].astype("i8"))
    begin = np.flatnonzero(equal[1:] & ~equal[:-1])  # runs of windows with `length` bytes in common
    finish = np.flatnonzero(equal[:-1] & ~equal[1:]) + 1
    if not len(begin):
        return
    edges = np.stack([begin, finish], 1).ravel()
    lowest, highest = (f.reduceat(np.append(before, 0), edges)[::2] for f in (np.minimum, np.maximum))
    diverse = (lowest != highest) | (lowest < 0)
    for l, r in zip(begin[diverse].tolist(), finish[diverse].tolist(), strict=True):
        # sort the run by what follows the window, and take the lengths that neighbours share
        keyed = sorted(((data[at[i] + length : stop[i]].tobytes(), i) for i in range(l, r)), key=lambda x: x[0])
        members = np.array([i for _, i in keyed])
        shared = [length]
        for (a, _), (b, _) in zip(keyed, keyed[1:], strict=False):
            n = min(len(a), len(b))
            k = next((x for x in range(n) if a[x] != b[x]), n) if a[:n] != b[:n] else n
            shared.append(length + k)
        left = before[members].tolist()

        def join(a: int, b: int) -> int:
            return a if a == b and a >= 0 else -2

        stack: list[list[int]] = []  # shared length, first member, byte before all members or -2
        for i in range(1, len(members) + 1):
            here = shared[i] if i < len(members) else 0
            first_member, side = i - 1, left[i - 1]
            side = side if side >= 0 else -2
            while stack and stack[-1][0] > here:
                size, lb, own = stack.pop()
                own = join(own, side)
                if own == -2:
                    yield size, at[members[lb:i]]
                first_member, side = lb, own
            if here >= length:
                if stack and stack[-1][0] == here:
                    stack[-1][2] = join(stack[-1][2], side)
                else:
                    stack.append([here, first_member, side])


def compare(length: int):
    """For ``mapInPandas`` over segments sorted by anchor: stretches to remove, by suffix arrays over whole anchors."""

    def removed(rows: list[tuple]) -> pd.DataFrame:
        rows = list(dict.fromkeys(rows))  # repeated rows are one document
        ids, th, s = (np.array([r[k] for r in rows], "i8") for k in (1, 2, 3))
        sizes = np.array([len(r[4]) for r in rows], "i8")
        data = np.frombuffer(b"".join(r[4] for r in rows), "u1")
        ends = np.cumsum(sizes)
        starts = ends - sizes
        by = np.lexsort((s, th, ids))
        document = np.empty(len(rows), "i8")
        document[by] = np.cumsum(np.concatenate([[False], (ids[by][1:] != ids[by][:-1]) | (th[by][1:] != th[by][:-1])]))
        docs, a, b = [], [], []
        for size, places in maximal_repeats(data, starts, ends, length):
            segment = np.searchsorted(ends, places, "right")
            absolute = s[segment] + places - starts[segment]
            order = np.lexsort((absolute, document[segment]))[1:]  # the first in the corpus stays
            docs.append(segment[order])
            a.append(absolute[order])
            b.append(absolute[order] + size)
        if not docs:
            return _found(*[np.empty(0, "i8")] * 4)
        segment = np.concatenate(docs)
        of = np.empty(len(rows), "i8")
        of[document] = np.arange(len(rows))
        d, a, b = _merged(document[segment], np.concatenate(a), np.concatenate(b))
        return _found(ids[of[d]], th[of[d]], a, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("h", "id", "th", "s", "segment")), strict=True):
                if size >= ARRAY_BYTES and row[0] != rows[-1][0]:
                    yield removed(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield removed(rows)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("id", F.coalesce(F.col(id_col), F.lit(_MAX))).withColumn("text_", text).withColumn("th", F.hash("text_"))


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MANY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``(id, th, s, e)``: stretches of bytes whose every ``length``-byte string also starts earlier; they may overlap.

    In each round every task hashes its texts and finds runs of windows under keys, so that equal windows have equal keys
    at equal distances. Runs travel to buckets of their key, packed, and only the first of equal segments from each task; a
    bucket keeps the first of equal segments. The different segments of a key agree in part: their bytes are fetched, and
    suffix arrays over whole keys give the maximal repeats among them, with all their places.

    A key of more than ``most`` different segments would make an array large. Its segments are the texts of the next round,
    whose keys take in more of the bytes around the anchor: fewer windows to a key, so that segments which agree in all of
    them become one. No round leaves anything out, and the last has keys of whole windows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("array<binary>")
    def taken(data: pd.Series, base: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([[d[x["s"] - b : x["e"] - b] for x in a] for d, b, a in zip(data, base, asked, strict=True)], dtype=object)

    texts = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    pieces = texts.where(F.octet_length("text_") >= length).select("id", "th", F.lit(0).alias("base"), F.encode("text_", "utf-8").alias("data"))
    volume = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PART_BYTES))
    buckets = max(parts, -(-volume // BUCKET_BYTES))
    gone = []
    for width in widths:
        packed = pieces.mapInPandas(gather(buckets, length, gram, width), _PACKED)
        found = cut(packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInPandas(settle(length, most), _FOUND))
        asked = found.where("h <> -1").groupBy("id", "th", "base").agg(F.collect_list(F.struct("h", "s", "e", "many")).alias("asked"))
        segments = cut(
            pieces.join(asked, ["id", "th", "base"])
            .select("id", "th", F.inline(F.arrays_zip("asked", taken("data", "base", "asked").alias("segment"))))
            .select("id", "th", "asked.h", "asked.s", "asked.many", "segment")
        )
        compared = segments.where("NOT many").repartition(parts, "h").sortWithinPartitions("h").mapInPandas(compare(length), _FOUND)
        gone += [found.where("h = -1").select("id", "th", "s", "e"), compared.select("id", "th", "s", "e")]
        pieces = segments.where("many").select("id", "th", F.col("s").alias("base"), F.col("segment").alias("data"))
        if not pieces.limit(1).count():
            break
    return functools.reduce(DataFrame.union, gone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MANY, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept``, the remaining bytes, ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one; strings never cross documents and are judged on the input. With ``as_text``, ``kept`` is text
    without the characters of which only a part remains.

    Null text counts as empty. Null ids come last. Rows of one id and equal text are one document, given more than once:
    they are no repeats of each other and get equal results. Rows of one id and different texts are documents in the
    order of a hash of the text. Columns named like an output column are replaced. An empty table gives an empty
    result.
    """
    names = ("kept", "n_bytes", "n_removed", "n_spans")
    widths = (length - gram + 1, *(w for w in WIDTHS[1:] if w <= length - gram))
    gone = repeated_stretches(docs, id_col, text_col, length, gram, most, widths).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("gone"))

    @F.pandas_udf(f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    def apply(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, stretches in zip(texts, gone, strict=True):
            raw = text.encode()
            if stretches is None:
                rows.append((raw, len(raw), 0, 0))
                continue
            s, e = np.array([(x["s"], x["e"]) for x in stretches], "i8").T
            _, s, e = _merged(np.zeros(len(s), "i8"), s, e)
            kept = [raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)]
            rows.append((b"".join(kept), len(raw), int((e - s).sum()), len(s)))
        out = pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])
        return out.assign(kept=out["kept"].map(lambda b: b.decode(errors="ignore"))) if as_text else out

    own = [c for c in docs.columns if c.lower() not in names]
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).alias("id_"), F.col(text_col).alias("text__")), "id_", "text__")
    return (
        rows.join(gone, ["id", "th"], "left")
        .select("row", apply("text_", "gone").alias("out"))
        .select(*[F.col("row").getField(c).alias(c) for c in own], *[F.col("out").getField(c).alias(c) for c in names])
    )
