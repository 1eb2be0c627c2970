"""Near-duplicates by SimHash, found with multi-index hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import small_batches
from tessella.operators.components import connected_components
from tessella.plans.lineage import cut

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Different fingerprints that share a half, beyond which the half is cut further.
MANY = 1000
#: Shingle hashes whose bits are counted at a time; bytes count up to 255.
COUNTED = 255 * 64


def shingle_hashes(text: str | None, words_each: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of a text of fewer words, of all of them; none without words.

    ``bytes.lower`` changes only A-Z and ``bytes.split`` cuts at exactly the ASCII white space asked for.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    n = max(1, len(words) - words_each + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(words_each, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def margins(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """For each of ``64 * words`` bits, in how many more of the hashes it is set than not. Its sign is the SimHash's bit.

    The first word counts the hashes themselves, each further word what a mixing of them by the word's number gives.
    """
    ones = np.zeros(64 * words, "i8")
    for k in range(0, len(hashes), COUNTED):
        some = hashes[k : k + COUNTED]
        with np.errstate(over="ignore"):
            wide = np.repeat(some[:, None], words, axis=1) + np.arange(words, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
            for _ in range(2 if words > 1 else 0):
                wide[:, 1:] = (wide[:, 1:] ^ (wide[:, 1:] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            wide[:, 1:] ^= wide[:, 1:] >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(wide, "<u8").view("u1"), axis=1, bitorder="little")
        even = len(bits) // 255 * 255
        ones += bits[:even].reshape(-1, 255, 64 * words).sum(axis=1, dtype="u1").sum(axis=0, dtype="i8") + bits[even:].sum(axis=0, dtype="u1")
    return 2 * ones - len(hashes)


def packed(margin: np.ndarray) -> np.ndarray:
    """The SimHash as longs: a bit is 1 if it is set in over half the hashes."""
    return np.packbits(margin > 0, bitorder="little").view("<i8")


def likely_balls(margin: np.ndarray, bits: int, flips: int) -> np.ndarray:
    """Keys of the segments of ``bits`` bits, each with its number ahead, and of their neighbours at one bit's distance.

    Of a ball of radius 1 only the ``flips`` neighbours are listed whose bit was decided most narrowly: these are the bits in
    which a near copy differs, if it differs in one. Two copies meet if one lists what the other lists, so they may differ in
    two such bits.
    """
    count = len(margin) // bits
    rows = margin[: count * bits].reshape(count, bits)
    own = (rows > 0) @ (np.int64(1) << np.arange(bits)) | np.arange(count) << bits
    narrow = np.argsort(np.abs(rows), axis=1, kind="stable")[:, :flips]
    return np.concatenate([own[:, None], own[:, None] ^ np.int64(1) << narrow], axis=1).ravel()


def fingerprint(text: str | None, words_each: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned number; 0 for a text without words."""
    return int(packed(margins(shingle_hashes(text, words_each)))[0]) % 2**64


def with_fingerprints(docs: DataFrame, text_col: str = "text", words_each: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words_each) for t in texts], "u8").view("i8"))

    return docs.withColumn("fp", simhash(text_col))


def segments(bits: int, name: str) -> str:
    """SQL: the two segments of ``bits`` bits of ``rest``, as rows of ``name``, a long that begins with its number, and the other segment."""
    part = lambda k: f"shiftrightunsigned(rest, {bits * k}) & {(1 << bits) - 1}L"
    return f"inline(array(struct({part(0)} AS {name}, {part(1)} AS rest), struct(({part(1)}) | {1 << bits}L AS {name}, {part(0)} AS rest)))"


def ball(key: str, bits: int, both_ways: bool) -> str:
    """SQL: a segment and its neighbours at one bit's distance; if not ``both_ways``, only those that have a one where it has a zero.

    Of two segments that differ in one bit, one has a zero there, so where both probe it is enough to set each zero bit.
    """
    at = f"sequence(0, {bits - 1})" if both_ways else f"filter(sequence(0, {bits - 1}), i -> ({key} & shiftleft(1L, i)) = 0)"
    return f"array_append(transform({at}, i -> {key} ^ shiftleft(1L, i)), {key})"


def candidates(fps: DataFrame, many: int = MANY) -> DataFrame:
    """``(src, dst)`` among which are all pairs of different fingerprints of ``fps.fp`` that differ in 3 bits or fewer.

    Cut in two halves, one half of such a pair differs in at most one bit. The table holds each fingerprint under its halves;
    probes look up each half and its one-bit neighbours. A half with more than ``many`` fingerprints makes no pairs itself: what
    meets there is cut again, in the same way, by the other half's 16 bits, and once more by 8 bits, after which 256 fingerprints
    at most are under one key. So the work of a hot half grows with its fingerprints, and not with their square.
    """
    keys: list[str] = []
    found = []
    held = probes = fps.select("fp", F.col("fp").alias("rest"))
    for bits in (32, 16, 8):
        keys = [*keys, f"k{bits}"]
        held, probes = (rows.selectExpr("fp", *keys[:-1], segments(bits, keys[-1])) for rows in (held, probes))
        # which way a pair met is settled by the first segment, so later ones look both ways
        probes = probes.selectExpr("fp", *keys[:-1], f"explode({ball(keys[-1], bits, bits < 32)}) AS {keys[-1]}", "rest")
        hot = cut(held.groupBy(*keys).count().where(F.col("count") > many).select(*keys)) if bits > 8 else None
        split = hot is not None and not hot.isEmpty()
        direct = held.join(hot, keys, "left_anti") if split else held
        found.append(probes.select(F.col("fp").alias("src"), *keys).join(direct.select(F.col("fp").alias("dst"), *keys), keys).select("src", "dst"))
        if not split:
            break
        held, probes = held.join(hot, keys, "left_semi"), probes.join(hot, keys, "left_semi")
    return functools.reduce(DataFrame.union, found).where("src <> dst")


def near_pairs(fps: DataFrame, distance: int = DISTANCE, many: int = MANY) -> DataFrame:
    """``(src, dst)`` pairs of different fingerprints of ``fps.fp`` that differ in ``distance`` bits or fewer (at most 3)."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    return candidates(fps, many).where(f"bit_count(src ^ dst) <= {distance}").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Rows of equal fingerprints are one node; nodes link at ``distance`` or fewer differing bits; a component's id is
    the smallest document id reachable. Fingerprints are aggregated before they are shuffled, so a large group of
    copies is one row.

    Null text counts as empty and has fingerprint zero, linked like any other. Null ids are kept and never the smallest
    while another id exists. Repeated rows give repeated rows. Texts are read whole, however long; their shingles are counted
    in parts. Further columns are not used, whatever their names. An empty table gives an empty result.
    """
    prints = cut(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", words_each).select("doc_id", "fp"))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_pairs(nodes, distance))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = cut(rooted)
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(roots.join(smallest, "root").select(F.col("fp").alias("node"), "component_id"))
    return prints.join(named, prints["fp"] == named["node"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
