"""Exact top-k inner products of quantised vectors by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.frames import arrow_rows
from tessella.plans.lineage import cut

K = 20
SCALE = 64
#: Vectors of a shard and queries of a block, about. Both numbers of rows are bounds, so a task's memory is one.
SHARD, BLOCK = 8192, 1024
#: Postings of the strongest term that the first threshold is taken from.
SEEDS = 512
#: A list of more than one in so many of a shard's vectors is laid out with a place for each vector.
DENSE = 8
#: Dimensions probed before vectors are dropped.
STEP = 4
#: Sums beyond this do not fit a long on the way; such shards and queries are counted in Python's numbers.
FITS = 2**62
#: Tasks that search at most, so that shards of a very large table share tasks.
TASKS = 8192
#: Pairs of a shard and a block in an Arrow batch.
BATCH_PAIRS = 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as double; null for a null vector or one with null or non-finite parts.

    Codes are longs; a component beyond 2**63 / ``scale`` is held at the end of their range.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Shard:
    """Posting lists of a shard. A term is a dimension with a sign; a posting, a vector with a component of that sign.

    A component of the sign of the query's raises the score, one of the other sign lowers it. So only terms of the
    query's own signs count for bounds, and what the others take away can be left for last.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # places then break ties like ids do
        self.ids, vectors = ids[order], vectors[order]
        narrow = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))) < 2**31
        self.columns = np.ascontiguousarray(vectors.T, "i4" if narrow else "i8")
        self.parts = {1: np.maximum(self.columns, 0), -1: np.minimum(self.columns, 0)}
        self.lists = {(d, sign): rows for sign, part in self.parts.items() for d, column in enumerate(part) if len(rows := np.flatnonzero(column))}
        self.values = {(d, sign): self.parts[sign][d] if len(rows) * DENSE > len(ids) else self.columns[d][rows] for (d, sign), rows in self.lists.items()}
        self.most = {term: max(abs(int(values.max())), abs(int(values.min()))) for term, values in self.values.items()}

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``, the query's own rows left out, ties to the smaller id.

        A first threshold comes from the first vectors of the strongest term's list. Terms are split, strongest first: those
        whose bounds together stay below the threshold are not essential, as a vector in none of the essential lists cannot
        reach it. Essential lists are traversed, each posting adding to its vector's sum. Vectors whose sum and the bounds
        of the other terms reach the threshold are probed: first for what essential dimensions take away, then in the
        others, strongest first, and dropped once they cannot reach it any more.
        """
        weights = {d: w for d, w in enumerate(query[: len(self.columns)].tolist()) if w}
        terms = {d: (d, 1 if w > 0 else -1) for d, w in weights.items()}
        bounds = {d: abs(w) * self.most.get(terms[d], 0) for d, w in weights.items()}
        reach = sum(abs(w) * max(self.most.get((d, 1), 0), self.most.get((d, -1), 0)) for d, w in weights.items())
        if reach >= FITS:
            return self._in_full(query_id, weights, k)
        kind = np.int32 if reach < 2**31 else np.int64  # holds any sum on the way
        weights = {d: kind(w) for d, w in weights.items()}
        ranked = sorted(bounds, key=lambda d: (-bounds[d], d))
        rest = np.cumsum([0, *(bounds[d] for d in reversed(ranked))])[::-1]  # bound on what dimension i and all after it add
        others = self.ids != query_id
        threshold = self._threshold(weights, terms[ranked[0]], others, k) if ranked else None
        if threshold is None:
            threshold = -reach
        # with a threshold that is not positive all terms are essential, and vectors in no list stay too
        essential = len(ranked) if threshold <= 0 else int((rest[:-1] >= threshold).sum())
        sums = np.zeros(len(self.ids), kind)
        for d in ranked[:essential]:
            rows, values = self.lists.get(terms[d]), self.values.get(terms[d])
            if rows is None:
                continue
            if len(values) == len(sums):
                sums += weights[d] * values
            else:
                sums[rows] += weights[d] * values
        found = np.flatnonzero(others & (sums >= threshold - rest[essential]))
        sums = sums[found]
        for n, d in enumerate(ranked[:essential], 1):
            sums = sums + weights[d] * self.parts[-terms[d][1]][d][found]
            if n % STEP == 0 or n == essential:
                still = sums >= threshold - rest[essential]
                found, sums = found[still], sums[still]
        for i, d in enumerate(ranked[essential:], essential):
            sums = sums + weights[d] * self.columns[d][found]
            still = sums >= threshold - rest[i + 1]
            found, sums = found[still], sums[still]
        if len(found) > k:
            keep = sums >= np.partition(sums, -k)[-k]
            found, sums = found[keep], sums[keep]
        best = np.lexsort((found, -sums))[:k]
        return self.ids[found[best]], sums[best].astype("i8")

    def _threshold(self, weights: dict[int, np.integer], strongest: tuple[int, int], others: np.ndarray, k: int) -> int | None:
        """A score that at least ``k`` vectors reach; none if the strongest term's list is too short to tell."""
        rows = self.lists.get(strongest, np.empty(0, "i8"))
        rows = rows[others[rows]][: max(SEEDS, k)]
        if len(rows) < k:
            return None
        sums = sum(w * self.columns[d][rows] for d, w in weights.items())
        return int(np.partition(sums, -k)[-k])

    def _in_full(self, query_id: int, weights: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """All scores in Python's numbers, for components so large that longs would overflow on the way."""
        sums = [0] * len(self.ids)
        for d, w in weights.items():
            sums = [s + w * x for s, x in zip(sums, self.columns[d].tolist(), strict=True)]
        sums = [min(max(s, -(2**63)), 2**63 - 1) for s in sums]
        best = sorted((i for i in range(len(sums)) if self.ids[i] != query_id), key=lambda i: (-sums[i], i))[:k]
        return self.ids[best], np.array([sums[i] for i in best], "i8")


def _matrix(codes: list) -> np.ndarray:
    out = np.zeros((len(codes), max(map(len, codes), default=0)), "<i8")
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _packed(rows: pd.DataFrame) -> dict:
    m = _matrix(rows["codes"].tolist())
    return {"ids": rows["vec_id"].to_numpy("<i8").tobytes(), "codes": m.tobytes(), "dims": m.shape[1]}


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row for which ``is_query`` holds.

    Rows are dealt by a hash of the id into shards of about ``shard`` vectors, and queries into blocks. Each block meets
    each shard once: the stated queries against all rows, in blocks. A shard gives its best ``k`` to each query; a window
    merges the shards.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. An id names a vector:
    repeated rows (same id and components) count once, and rows of the query's id are its own. Missing components of
    shorter vectors count as zero. Ties go to the smaller id. If fewer than ``k`` other rows exist, all are returned. Scores
    are integers without rounding; one that no long can hold counts as the end of a long's range. Further columns are not used, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("codes"), is_query.alias("asks"))
        .where("vec_id IS NOT NULL AND codes IS NOT NULL")
        .dropDuplicates(["vec_id", "codes"])
    )
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard)), max(1, -(-counts["q"] // block))

    def shard_of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"shard": key[0], **_packed(group)}])

    def block_of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": key[0], **_packed(group)}])

    dealt = F.xxhash64("vec_id")
    held = rows.withColumn("shard", F.pmod(dealt, F.lit(shards))).groupBy("shard").applyInPandas(shard_of, "shard long, ids binary, codes binary, dims int")
    asked = rows.where("asks").withColumn("block", F.pmod(dealt, F.lit(blocks))).groupBy("block").applyInPandas(block_of, "block long, ids binary, codes binary, dims int")
    asked = asked.select("block", F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), F.col("dims").alias("q_dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.shard != at:
                    at, index = r.shard, Shard(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.codes, "<i8").reshape(-1, r.dims))
                out = []
                for q, v in zip(np.frombuffer(r.q_ids, "<i8").tolist(), np.frombuffer(r.q_codes, "<i8").reshape(-1, r.q_dims), strict=True):
                    ids, scores = index.top(q, v, k)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores.astype("i8")}))
                if out:
                    yield pd.concat(out)

    # a number of partitions that is asked for is kept: shards are searched side by side even where their bytes are few
    tasks = min(shards, TASKS)
    pairs = asked.repartition(tasks, "shard").join(held.repartition(tasks, "shard"), "shard").select("shard", "ids", "codes", "dims", "q_ids", "q_codes", "q_dims")
    with arrow_rows(spark, BATCH_PAIRS):  # a row of these is a whole shard and a whole block
        found = cut(pairs.mapInPandas(search, "query_id long, vec_id long, score long"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
