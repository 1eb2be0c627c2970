"""Near copies: wide SimHashes find candidates by multi-index hashing, whole sets of word shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.frames import small_batches
from tessella.llm.simhash import SEED, likely_balls, margins, packed, shingle_hashes
from tessella.operators.components import connected_components
from tessella.plans.lineage import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Longs of a fingerprint, bits of a segment, and narrowly decided bits that are flipped in each: 21 segments of 24 bits, 84
#: keys. Two sets of a similarity of just over 0.8 differ in about a seventh of the bits; nine such pairs in ten share a key.
WORDS, BITS, FLIPS = 8, 24, 3
#: Bits in which similar texts differ at most, in one long and in all: over three standard deviations above the mean at 0.8.
WORD_APART, APART = 20, 112
#: Rows of two longs that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: For products like 0.8 * 15 that floating point puts beside the whole number.
EPS = 1e-9


def shingles(text: str | None, words_each: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, words_each))


def distance(a: str, b: str, words: int = WORDS) -> Column:
    """Differing bits of two fingerprints given as arrays of longs."""
    return F.expr("+".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(words)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Longs with a bit for each remainder of the hashes: 1 if an odd number of them leaves it. At least a bit for each hash.

    Every hash in only one of two sets changes one bit, so as many bits as differ, at least so many hashes do. The number of bits is
    a power of two, so the bits for half the remainders are the two halves, one xor the other.
    """
    bits = 64 << (max(0, len(hashes) - 1) // 64).bit_length()
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def fewest_apart(a: str, b: str) -> Column:
    """Hashes that are in only one of two sets, at least, by their ``parities``; 0 if one has over twice as many longs."""
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p ^ q)"
    count = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (n, k) -> n + k)"
    cases = ((f"size({a}) = size({b})", a, b), (f"size({a}) = 2 * size({b})", half(a), b), (f"size({b}) = 2 * size({a})", a, half(b)))
    return F.expr("CASE " + " ".join(f"WHEN {when} THEN {count(x, y)}" for when, x, y in cases) + " ELSE 0 END")


def whole_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, words_each: int) -> DataFrame:
    """``(node, held)``: the sets of shingles of ``wanted`` nodes, from one text each."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, words_each).view("i8"))

    wanted = cut(wanted.select("node").distinct().join(nodes, "node").select("node", "rk"))
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return cut(rows.join(few, "rk").groupBy("node").agg(F.first("text").alias("text")).select("node", sets("text").alias("held")))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words_each: int, similarity: float, held: DataFrame | None = None) -> DataFrame:
    """The ``(src, dst)`` of ``pairs`` whose complete fingerprints are near and whose whole sets have the similarity.

    Whole sets travel only for pairs whose parities leave the similarity possible, which are few that do not have it.
    """
    side = lambda name: nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("ws", "n", "odd")])
    alike = F.least("n_src", "n_dst") >= similarity * F.greatest("n_src", "n_dst") - EPS
    possible = fewest_apart("odd_src", "odd_dst") <= (1 - similarity) / (1 + similarity) * (F.col("n_src") + F.col("n_dst")) + EPS
    near = pairs.distinct().join(side("src"), "src").join(side("dst"), "dst").where(alike & (distance("ws_src", "ws_dst") <= APART) & possible)
    near = cut(near.select("src", "dst"))
    if held is None:
        held = whole_sets(near.select(F.col("src").alias("node")).union(near.select("dst")), nodes, rows, words_each)
    a, b = held.select(F.col("node").alias("src"), F.col("held").alias("a")), held.select(F.col("node").alias("dst"), F.col("held").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return cut(near.join(a, "src").join(b, "dst").where(both >= similarity * (F.size("a") + F.size("b") - both) - EPS).select("src", "dst"))


def with_main(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``part``) under keys that hold several parts, with ``main``, the part of most of a key's rows."""
    main = rows.groupBy(key, "part").count().groupBy(key).agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
    return rows.join(main.where("parts > 1").drop("parts"), key)


def sharing_rare(held: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)`` of nodes in different parts that can have the similarity, by the rare shingles that they share.

    In any order of shingles, two such sets share one of the first ``n - ceil(similarity * n) + 1``. With rare ones first, texts that
    were changed in many places share none of theirs. Where a first common one stands bounds what may follow.
    """
    tokens = held.select("node", F.explode("held").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    n = F.size("all")
    first = ordered.select("node", n.alias("n"), F.posexplode(F.slice("all", F.lit(1), n - F.ceil(similarity * n - EPS).cast("int") + 1)).alias("pos", "t")).where("t.df > 1")
    rows = with_main(cut(first.select("node", "n", "pos", "t.token").join(parts, "node")), "token")
    side = lambda x, these: these.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "part")])
    follow = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - EPS
    alike = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - EPS
    return side("a", rows.where("part <> main")).join(side("b", rows), "token").where("part_a <> part_b").where(follow & alike).select(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``kept``: true for one row of each group linked by texts of ``similarity`` or more.

    Similarity is the Jaccard similarity of the sets of word shingles. Candidates come from multi-index hashing: a SimHash of
    512 bits over the set is cut into segments; each fingerprint is listed under its segments and a small ball around them
    (see ``likely_balls``), and distances are checked. Whole sets decide, so no link is wrong; a pair of just over 0.8 may be
    missed (measured recall in the README).

    Of all nodes under a key, the smallest is compared with the others first. What is then still close to a node of another
    component is compared by the rare shingles that such nodes share. So a large group of texts makes pairs
    in proportion to its size, also where many of them are just not similar enough.

    Rows of equal sets are one node, named by a 64-bit hash, as are rows of equal id and text. The row with the smallest id is
    kept, a null id only where there is no other; of rows with the same id and text any one, of rows with the same id and
    different texts the one of the smaller hash. Null text counts as empty. Texts without words are copies of each other. A column
    named ``kept`` is replaced. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), text)
    rows = docs.select(key.alias("rk"), F.col(id_col).alias("id"), text.alias("text"))

    @F.pandas_udf("node long, n int, ws array<long>, odd array<long>, keys array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, words_each) for t in texts]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), "u8", len(sets)).view("i8")
            counted = [margins(s, WORDS) for s in sets]
            yield pd.DataFrame({"node": node, "n": list(map(len, sets)), "ws": list(map(packed, counted)), "odd": list(map(parities, sets)), "keys": [likely_balls(m, BITS, FLIPS) for m in counted]})

    printed = cut(rows.select("rk", "id", prints("text").alias("p")).select("rk", "id", "p.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk")).alias("first")
    nodes = cut(printed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "ws", "odd", "keys")], first).select("node", "n", "ws", "odd", "keys", "first", "first.rk"))

    listed = nodes.select(F.explode("keys").alias("key"), F.struct("node", F.col("ws")[0].alias("w")).alias("at"))
    close = lambda x, y: F.expr(f"bit_count({x}.w ^ {y}.w) <= {WORD_APART}")
    # rows with a close node under their key; what meets by chance goes here, and no pairs are made
    met = listed.select("key", F.col("at").alias("other"))
    shared = cut(listed.join(met, (listed["key"] == met["key"]) & F.expr("at.node <> other.node") & close("at", "other"), "left_semi"))
    pivots = shared.groupBy("key").agg(F.min("at").alias("lo"))
    to_pivot = shared.join(pivots, "key").where(F.expr("at.node <> lo.node") & close("at", "lo")).select(F.col("lo.node").alias("src"), F.col("at.node").alias("dst"))
    edges = verified(to_pivot, nodes, rows, words_each, similarity)

    linked = cut(nodes.select("node").join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("part")))
    left = cut(with_main(shared.select("key", "at", F.col("at.node").alias("node")).join(linked, "node").select("key", "at", "part"), "key"))
    strays, mains = left.where("part <> main").select("key", F.col("at").alias("b"), F.col("part").alias("part_b")), left.where("part = main").select("key", F.col("at").alias("b"))
    open_ = left.join(strays, (left["key"] == strays["key"]) & (left["part"] != strays["part_b"]) & close("at", "b"), "left_semi")
    open_ = open_.union(left.where("part <> main").join(mains, (left["key"] == mains["key"]) & close("at", "b"), "left_semi"))
    held = whole_sets(cut(open_.select(F.col("at.node").alias("node")).distinct()), nodes, rows, words_each)
    more = verified(sharing_rare(held, linked, similarity), nodes, rows, words_each, similarity, held)

    # what was linked first is one node of the second graph
    end = lambda name: linked.select(F.col("node").alias(name), F.col("part").alias(f"part_{name}"))
    merged = connected_components(more.join(end("src"), "src").join(end("dst"), "dst"), "part_src", "part_dst").withColumnRenamed("node", "part")
    root = F.coalesce("component", "part").alias("root")
    kept = nodes.join(linked, "node").join(merged, "part", "left").groupBy(root).agg(F.min("first").alias("first")).select(F.col("first.rk").alias("kept_rk"))
    own = [c for c in docs.columns if c.lower() != "kept"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("rk")).join(cut(kept), F.col("rk") == F.col("kept_rk"), "left")
    stays = F.col("kept_rk").isNotNull() & (F.row_number().over(W.partitionBy("rk").orderBy("rk")) == 1)
    return whole.withColumn("stays", stays).select(*[F.col("row").getField(c).alias(c) for c in own], F.col("stays").alias("kept"))
