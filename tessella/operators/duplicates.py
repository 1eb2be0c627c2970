"""Duplicates and clusters of images and vectors: hashes, pairs, components, leaders."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.blocks import alike, asked_of_all, dealt, meet, second
from tessella.operators.components import connected_components
from tessella.plans.lineage import cut
from tessella.registry import query
from tessella.sources.views import Views

logger = logging.getLogger(__name__)


def dhash(pixels: Column, width: int, height: int) -> Column:
    """A difference hash: a bit for each pixel that is darker than its right neighbour, row by row, lowest bit first."""
    cells = [(row, col) for row in range(height) for col in range(width - 1)]
    bits = F.array(*[F.when(pixels[r * width + c] < pixels[r * width + c + 1], F.shiftleft(F.lit(1).cast("long"), r * (width - 1) + c)).otherwise(F.lit(0).cast("long")) for r, c in cells])
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid(v: Views) -> DataFrame:
    """Vectors read as grey grids of 8 by 8 pixels."""
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("pixels"))


def hashes(v: Views) -> DataFrame:
    return grid(v).select("id", dhash(F.col("pixels"), 8, 8).alias("h"))


HASHES = """h AS (SELECT vec_id AS id, list_sum(list_transform(range(56), lambda i: CASE WHEN floor((embedding[(i // 7) * 8 + i % 7 + 1]::DOUBLE + 1) * 127.5) < floor((embedding[(i // 7) * 8 + i % 7 + 2]::DOUBLE + 1) * 127.5) THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT AS h FROM embeddings)"""


@query(f"WITH {HASHES} SELECT id, h FROM h", name="dhash")
def dhash_of(v: Views) -> DataFrame:
    return hashes(v)


def hamming_pairs_within(rows: DataFrame, distance: int, bits: int = 56) -> DataFrame:
    """Pairs of ids whose hashes differ in at most ``distance`` bits.

    Cut into ``distance // 2 + 1`` bands, two such hashes differ in at most one bit of some band. So each hash is held under its
    bands, and looked up under them and their neighbours at one bit's distance; of two such bands one has a zero where they
    differ, so it is enough to set each zero bit. Rows of equal hashes are one row there, and only their first ids are paired
    with others.
    """
    bands = distance // 2 + 1
    width = -(-bits // bands)
    firsts = rows.groupBy("h").agg(F.min("id").alias("id"))
    band = f"transform(sequence(0, {bands - 1}), k -> struct(k AS band, shiftrightunsigned(h, k * {width}) & {(1 << width) - 1}L AS key))"
    near = f"transform(filter(sequence(0, {width - 1}), i -> (b.key & shiftleft(1L, i)) = 0), i -> struct(b.band AS band, b.key | shiftleft(1L, i) AS key))"
    probes = firsts.selectExpr("id", "h", f"inline(flatten(transform({band}, b -> array_append({near}, b))))")
    held = firsts.selectExpr("id AS id2", "h AS h2", f"inline({band})")
    found = probes.join(held, ["band", "key"]).where("id <> id2").where(hamming(F.col("h"), F.col("h2")) <= distance).select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")).distinct()
    same = rows.join(firsts.select("h", F.col("id").alias("first")), "h").where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("id2"))
    return found.union(same)


def copies(v: Views) -> DataFrame:
    """Hashes of images, three to a grid: the grid's own, one that differs in two bits, and one that differs from that in three."""
    first, second = F.expr("id % 28"), F.expr("28 + id % 28")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    near = F.col("h").bitwiseXOR(bit(first)).bitwiseXOR(bit(second))
    far = near.bitwiseXOR(bit((first + 1) % 28)).bitwiseXOR(bit((first + 2) % 28)).bitwiseXOR(bit((first + 3) % 28))
    return hashes(v).select(F.posexplode(F.array("h", near, far)).alias("n", "h"), F.col("id").alias("grid")).select((F.col("grid") * 3 + F.col("n")).alias("id"), "h")


COPIES = HASHES + """, n AS (SELECT id, h, xor(xor(h, 1::BIGINT << (id % 28)::INT), 1::BIGINT << (28 + id % 28)::INT) AS h1 FROM h),
    c AS (SELECT id * 3 AS id, h FROM n UNION ALL SELECT id * 3 + 1, h1 FROM n UNION ALL SELECT id * 3 + 2, xor(xor(xor(h1, 1::BIGINT << ((id % 28 + 1) % 28)::INT), 1::BIGINT << ((id % 28 + 2) % 28)::INT), 1::BIGINT << ((id % 28 + 3) % 28)::INT) FROM n),
    f AS (SELECT h, min(id) AS id FROM c GROUP BY 1), p AS (SELECT a.id, b.id AS id2 FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4 UNION ALL SELECT f.id, c.id FROM c JOIN f USING (h) WHERE c.id <> f.id)"""


@query(f"WITH {COPIES} SELECT id, id2 FROM p")
def hamming_pairs(v: Views) -> DataFrame:
    return hamming_pairs_within(copies(v), 4)


def clusters(pairs: DataFrame) -> DataFrame:
    """``(id, cluster)`` for every id that is like another, directly or by way of others."""
    return connected_components(pairs, "id", "id2").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


#: Components by reachability, for small graphs.
REACH = """e AS (SELECT id AS a, id2 AS b FROM p UNION SELECT id2, id FROM p), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a AS id, least(a, min(b)) AS cluster FROM r GROUP BY a"""


@query(f"WITH {COPIES}, " + REACH)
def hamming_clusters(v: Views) -> DataFrame:
    """Images that are alike by way of others too: the third of a grid is like its second, which is like the first."""
    return clusters(hamming_pairs_within(copies(v), 4))


def cosine_pairs_within(rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """Pairs of ids whose vectors have a cosine of ``least`` or more, exactly.

    Cosine has no key to join on, so all rows meet all rows, but in blocks: vectors are gathered into matrices, each pair of
    blocks is one product, and only pairs that qualify leave a task.
    """
    blocks, count = dealt(rows.withColumn("flag", F.lit(False)), block)
    left = blocks.select("ids", "kind", "m", F.explode(F.sequence("b", F.lit(count - 1).cast("long"))).alias("b2"))

    def found(a: np.ndarray, b: np.ndarray, _: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        i, j = a[at[0]], b[at[1]]
        if a[0] in b:  # a block with itself finds each pair from both sides
            i, j = i[i < j], j[i < j]
        return pd.DataFrame({"id": np.minimum(i, j), "id2": np.maximum(i, j)}).drop_duplicates()

    return meet(left.join(second(blocks), "b2"), found, "id long, id2 long", alike(least))


PAIRS = "p AS (SELECT a.vec_id AS id, b.vec_id AS id2 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4)"


def _vectors(v: Views) -> DataFrame:
    return v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {PAIRS} SELECT id, id2 FROM p")
def cosine_pairs(v: Views) -> DataFrame:
    return cosine_pairs_within(_vectors(v), 0.4)


@query("WITH " + PAIRS + ", " + REACH)
def cosine_clusters(v: Views) -> DataFrame:
    return clusters(cosine_pairs_within(_vectors(v), 0.4))


def leaders(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """Per document, images in order: each joins the first group whose leader it is like, or leads a new one.

    ``keep`` is a group's largest image. Likeness is judged against the leader only, so groups are not transitive. A
    document's images are one group of rows; they are few, as a page of images is capped before.
    """

    def grouped(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        found: list[list[int]] = []
        m = np.stack(group["v"].to_list()).astype("f8")
        sizes = np.linalg.norm(m, axis=1)
        for i in range(len(group)):
            for members in found:
                j = members[0]
                if sizes[i] and sizes[j] and m[i] @ m[j] / (sizes[i] * sizes[j]) >= least:
                    members.append(i)
                    break
            else:
                found.append([i])
        ids, large = group["id"].tolist(), group["size"].tolist()
        rows = []
        for members in found:
            keep = max(members, key=lambda i: large[i])
            rows += [(group["doc_id"].iloc[0], ids[i], ids[members[0]], ids[i] == ids[keep]) for i in members]
        return pd.DataFrame(rows, columns=["doc_id", "id", "leader", "keep"])

    return rows.groupBy("doc_id").applyInPandas(grouped, "doc_id long, id long, leader long, keep boolean")


@query()
def leader_dedup(v: Views) -> DataFrame:
    rows = v.chunks.where("embedding IS NOT NULL").select("doc_id", "id", F.col("embedding").alias("v"), F.length(F.coalesce("caption", "content_text")).alias("size"))
    return leaders(rows, 0.2)


def first_match(new: DataFrame, store: DataFrame, least: float = 0.95) -> DataFrame:
    """``(id, match)`` for each of ``new`` (id, v) that ``store`` (id, v) has something like: the smallest id with that cosine."""

    def found(a: np.ndarray, b: np.ndarray, _: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        first = np.full(len(a), np.iinfo("i8").max)
        np.minimum.at(first, at[0], b[at[1]])
        hit = first < np.iinfo("i8").max
        return pd.DataFrame({"id": a[hit], "match": first[hit]})

    return asked_of_all(new, store.withColumn("flag", F.lit(False)), found, "id long, match long", score=alike(least)).groupBy("id").agg(F.min("match").alias("match"))


def first_independent(edges: DataFrame) -> DataFrame:
    """The nodes of ``edges`` (a, b; a before b) that a walk in order would take: each that has no neighbour taken before it.

    In each round all nodes without an open node before them are taken, and what follows them goes, with all its edges. That is
    the set of the sequential walk, the lexicographically first independent set, after few rounds (in random orders about as
    many as the logarithm of the number of nodes). Rounds go on until no edge is open.
    """
    nodes = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    open_, rounds = cut(edges.select("a", "b").distinct()), 0
    gone = None  # nodes that follow one that was taken; kept distinct, so that its partitions do not add up round by round
    while True:
        late = open_.select(F.col("b").alias("id")).distinct()
        now = cut(open_.select(F.col("a").alias("id")).distinct().join(late, "id", "left_anti"))
        if now.isEmpty():
            break
        rounds += 1
        after = cut(open_.join(now, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct())
        gone = after if gone is None else cut(gone.union(after).distinct())
        left = open_.join(now, F.col("a") == F.col("id"), "left_anti").join(after, F.col("b") == F.col("id"), "left_anti")
        open_ = cut(left.join(after, F.col("a") == F.col("id"), "left_anti"))
    logger.info("first independent set: %d rounds", rounds)
    return nodes if gone is None else nodes.join(gone, "id", "left_anti")


def directed(vector: Column) -> Column:
    """Whether a vector has a direction, so that it is like its copies: its numbers are finite and not all zero."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((squares > 0) & (squares < float("inf")), F.lit(False))


def ordered_store(new: DataFrame, store: DataFrame, least: float = 0.95, content: str | None = None) -> DataFrame:
    """``(id, stored_as)`` of each of ``new`` (id, v), saved one after the other by id into ``store`` (id, v), which grows.

    What is like something stored, by a cosine of ``least`` or more, is stored as the first such thing: the smallest id of the store
    as it was, else the first new one that was itself saved. So the answer depends on the order, as saving one by one does, but is found
    by rounds over the graph of like ones. Ids of the store and of new ones may not meet. Copies by ``content``, a column of
    ``new``, are saved once, whatever their vector; null content is no copy. A null vector, or one without direction, is like
    nothing. Rows that repeat an id are one, the first in order. Pairs are found in blocks, all against all, as a cosine has no
    key to join on. Of equal vectors only the first takes part, as the others are stored as it is: so copies make no pairs.
    """
    copy = F.coalesce(F.col(content).cast("string"), F.concat(F.lit("#"), F.col("id"))) if content else F.concat(F.lit("#"), F.col("id"))
    rows = cut(new.select("id", F.col("v").alias("v"), copy.alias("copy")).groupBy("id").agg(F.min(F.struct("copy", "v")).alias("r")).select("id", "r.v", F.min("id").over(W.partitionBy("r.copy")).alias("first")))
    held = rows.where("id = first").select("id", "v").where(directed(F.col("v")))
    firsts = cut(held.groupBy("v").agg(F.min("id").alias("id")))
    equal = held.withColumnRenamed("id", "first").join(firsts.withColumnRenamed("id", "leads"), "v").select("first", "leads")
    known = cut(first_match(firsts, store.where(directed(F.col("v"))).groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), least))
    fresh = firsts.join(known, "id", "left_anti")
    edges = cut(cosine_pairs_within(fresh, least).select(F.col("id").alias("a"), F.col("id2").alias("b")))
    saved = cut(first_independent(edges))
    like = edges.join(saved, F.col("a") == F.col("id"), "left_semi").join(saved, F.col("b") == F.col("id"), "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("match"))
    stored = known.union(like).withColumnRenamed("id", "leads")
    return rows.join(equal, "first", "left").join(stored, "leads", "left").select("id", F.coalesce("match", "leads", "first").alias("stored_as"))


@query("""WITH n AS (SELECT vec_id AS id, embedding AS v, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 4 = 3),
    st AS (SELECT n.id, min(s.vec_id) AS s FROM n JOIN embeddings s ON s.vec_id % 4 <> 3 AND round(list_cosine_similarity(n.v::DOUBLE[], s.embedding::DOUBLE[]), 6) >= 0.45 GROUP BY n.id),
    near AS (SELECT b.id, list(a.id) AS before FROM n a JOIN n b ON a.id < b.id AND round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 6) >= 0.45 GROUP BY b.id),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS saved, NULL::BIGINT AS id, NULL::BIGINT AS stored_as
        UNION ALL SELECT n.n, CASE WHEN st.s IS NULL AND len(list_intersect(saved, coalesce(before, []))) = 0 THEN list_append(saved, n.id) ELSE saved END, n.id, coalesce(st.s, list_min(list_intersect(saved, coalesce(before, []))), n.id)
        FROM walk JOIN n ON n.n = walk.n + 1 LEFT JOIN st ON st.id = n.id LEFT JOIN near ON near.id = n.id)
    SELECT id, stored_as FROM walk WHERE id IS NOT NULL""")
def greedy_store_dedup(v: Views) -> DataFrame:
    """Every fourth vector is new and saved one after the other."""
    rows = _vectors(v)
    return ordered_store(rows.where("id % 4 = 3"), rows.where("id % 4 <> 3"), 0.45)


@query("""WITH s AS (SELECT sha256, min(doc_id) AS doc_id FROM docs WHERE doc_id % 3 <> 1 GROUP BY 1), n AS (SELECT sha256, doc_id, min(doc_id) OVER (PARTITION BY sha256) AS first FROM docs WHERE doc_id % 3 = 1)
    SELECT n.doc_id, coalesce(s.doc_id, n.first) AS stored_as, CASE WHEN s.doc_id IS NOT NULL THEN 'stored' WHEN n.first < n.doc_id THEN 'copy' ELSE 'new' END AS how FROM n LEFT JOIN s USING (sha256)""")
def save_by_content(v: Views) -> DataFrame:
    """What is new is saved under its content's hash: not if the store has it, and once if several new ones are equal."""
    stored = v.docs.where("doc_id % 3 <> 1").groupBy("sha256").agg(F.min("doc_id").alias("stored"))
    first = v.docs.where("doc_id % 3 = 1").groupBy("sha256").agg(F.min("doc_id").alias("first"))
    rows = v.docs.where("doc_id % 3 = 1").select("doc_id", "sha256").join(first, "sha256").join(stored, "sha256", "left")
    how = F.when(F.col("stored").isNotNull(), "stored").when(F.col("first") < F.col("doc_id"), "copy").otherwise("new")
    return rows.select("doc_id", F.coalesce("stored", "first").alias("stored_as"), how.alias("how"))
