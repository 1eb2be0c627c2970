"""An index of vectors by cells: k-means on a bounded sample, every row assigned, cells read by bound or by nearness."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessella.functions.blocks import BLOCK, BLOCKS, LARGEST, STRIP, cosines, number_type
from tessella.functions.vectors import cosine_to
from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut, ensure_checkpoint_dir
from tessella.registry import query
from tessella.sources.views import Views

#: Vectors that cells are fitted on at most (on the driver), and cells at most.
SAMPLE, CELLS = 16_384, 1024
ROUNDS = 10
#: Share of the cells that a search with probes reads. The given vectors are nearly uncorrelated, so it is large.
PROBE = 0.6
#: The cell of vectors that have no direction or other numbers of components: it is always read.
ODD = -1
#: Against rounding of distances.
EPS = 1e-6


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of at most ``cells`` groups of unit vectors, by Lloyd's rounds from a random start; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


@dataclass
class Cells:
    """Where an index lies, and what a search plans with: centres, the greatest distance of a member from its centre, members."""

    path: str
    schema: StructType
    centres: np.ndarray
    radii: np.ndarray
    members: np.ndarray
    odd: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, vector_col: str = "embedding", id_col: str = "id", sample: int = SAMPLE, cells: int = CELLS) -> Cells:
        """Writes ``rows`` with their ``cell`` in the order of cells, and the table of cells beside them.

        The centres are fitted on the at most ``sample`` vectors of the lowest hashed ids; every row is assigned to its nearest
        centre. There are about as many cells as the square root of the rows, ``cells`` at most. Rows whose vector is null or
        not finite take no part; a zero vector, or one of another length than most of the sample, goes to a cell that is always
        read. An empty table makes an index without cells.
        """
        spark = rows.sparkSession
        rows = rows.where(F.col(vector_col).isNotNull() & finite(F.col(vector_col)))
        drawn = rows.select(id_col, vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
        lengths = [len(r[vector_col]) for r in drawn]
        dims = max(sorted(set(lengths)), key=lengths.count, default=0)
        known = [r[vector_col] for r in drawn if len(r[vector_col]) == dims and any(r[vector_col])]
        count = rows.count()
        centres = fitted(unit_rows(np.array(known, "f8")), max(1, min(cells, math.isqrt(count)))) if known else np.zeros((0, dims))

        @F.pandas_udf(StructType([StructField("cell", IntegerType()), StructField("away", DoubleType())]))
        def assigned(vectors: pd.Series) -> pd.DataFrame:
            cell, away = np.full(len(vectors), ODD), np.zeros(len(vectors))
            fit = np.array([len(v) == dims and any(v) for v in vectors], bool)
            if fit.any() and len(centres):
                m = unit_rows(np.stack(vectors[fit].to_list()).astype("f8"))
                squares = (m * m).sum(axis=1)[:, None] - 2 * m @ centres.T + (centres * centres).sum(axis=1)
                cell[fit] = squares.argmin(axis=1)
                away[fit] = np.sqrt(np.maximum(squares.min(axis=1), 0))
            return pd.DataFrame({"cell": cell, "away": away})

        placed = rows.withColumn("at", assigned(vector_col)).select("*", "at.cell", "at.away").drop("at")
        placed.repartitionByRange("cell", id_col).sortWithinPartitions("cell").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row for each cell
        by_cell = {r["cell"]: r for r in sizes}
        lines = [(c, centres[c].tolist(), by_cell[c]["radius"], by_cell[c]["n"]) for c in range(len(centres)) if c in by_cell]
        if ODD in by_cell:
            lines.append((ODD, [0.0] * dims, 0.0, by_cell[ODD]["n"]))
        spark.createDataFrame(lines, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        found = spark.read.parquet(f"{path}/cells").collect()
        held = {r["cell"]: r for r in found if r["cell"] != ODD}
        top = max(held, default=-1) + 1
        dims = len(found[0]["centre"]) if found else 0
        centres, radii, members = np.full((top, dims), np.inf), np.zeros(top), np.zeros(top, "i8")
        for c, r in held.items():
            centres[c], radii[c], members[c] = r["centre"], r["radius"], r["n"]
        return cls(path, spark.read.parquet(f"{path}/rows").schema, centres, radii, members, sum(r["n"] for r in found if r["cell"] == ODD))

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        """The rows of some cells; others are not read where a file's or a row group's statistics leave them out."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col("cell").isin([*map(int, cells), ODD]))

    def distances(self, question: list[float]) -> np.ndarray:
        """Of the question's direction from each centre; infinite where a cell has no members."""
        q = np.asarray(question, "f8")
        q = np.pad(q, (0, max(0, self.centres.shape[1] - len(q))))[: self.centres.shape[1]]
        size = np.linalg.norm(q)
        out = np.linalg.norm(np.where(np.isinf(self.centres), 0, self.centres) - (q / size if size else q), axis=1)
        return np.where(self.members > 0, out, np.inf)

    def nearest(self, question: list[float], share: float) -> list[int]:
        """The share of the cells whose centres are nearest, at least one."""
        d = self.distances(question)
        held = int((self.members > 0).sum())
        return np.argsort(d, kind="stable")[: min(held, max(1, math.ceil(share * held)))].tolist()

    def within(self, question: list[float], score: float) -> list[int]:
        """The cells that can hold a vector of that cosine or more: by the triangle inequality, nearer than centre and radius allow."""
        reach = math.sqrt(max(0.0, 2 - 2 * score)) + EPS
        return np.flatnonzero(self.distances(question) - self.radii <= reach).tolist()

    def top(self, spark: SparkSession, question: list[float], k: int, keep: Column | None = None, probe: float | None = None, vector_col: str = "embedding", id_col: str = "id") -> tuple[DataFrame, list[int]]:
        """The ``k`` best rows by cosine (six decimals, ties to the smaller id) with ``score``, and the cells that were read.

        With ``probe``, only that share of the cells. Without, the answer is exact: the nearest cells that have more than ``k`` rows
        give a score that the ``k``-th best reaches, and then every cell is read that can hold as good a one. ``keep`` filters
        the rows; what it leaves may be few, so that more cells, in the end all, are read. A zero question is as far from all.
        """
        keep = F.lit(True) if keep is None else keep
        score = F.round(cosine_to(question)(F.col(vector_col)), 6)
        best = lambda cells: self.rows(spark, cells).where(keep).withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)
        if probe is not None:
            cells = self.nearest(question, probe)
        elif not any(question):
            cells = np.flatnonzero(self.members > 0).tolist()
        else:
            order = self.nearest(question, 1.0)
            first = order[: int(np.searchsorted(np.cumsum(self.members[order]), 2 * k)) + 1]
            low = best(first).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            cells = self.within(question, low["least"] - EPS) if low["n"] == k else order
        return best(cells).drop("cell", "away"), cells


def in_blocks(sizes: list[int], most: int) -> tuple[list[int], list[int]]:
    """The first block of each cell, and how many it has: neighbours share a block of ``most`` rows, a larger cell has its own."""
    start, parts, at, held = [], [], 0, 0
    for n in sizes:
        if held and held + n > most:
            at, held = at + 1, 0
        start.append(at)
        parts.append(max(1, -(-n // most)))
        at, held = (at + parts[-1], 0) if parts[-1] > 1 else (at, held + n)
    return start, parts


def probed(index: Cells, asked: DataFrame, k: int, probe: float = PROBE, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """``(prompt, rank, id, score, cells_read)``: the ``k`` best of many questions (prompt, v), each in its share of nearest cells.

    Cells lie in blocks of at most ``LARGEST`` rows. Questions meet the blocks that hold cells of theirs by a join; a block and some
    questions are one product of matrices, in which only the rows of a question's cells count, and of which its ``k`` best leave
    the task. A question takes no part in its own answer.
    """
    spark, odd = asked.sparkSession, len(index.members)  # the odd cell comes last
    sizes = [*map(int, index.members), index.odd]
    start, parts = in_blocks(sizes, min(LARGEST, max(BLOCK, sum(sizes) // BLOCKS)))
    places = spark.createDataFrame([(c if c < odd else ODD, s, n) for c, (s, n) in enumerate(zip(start, parts, strict=True))], "cell int, s int, n int")
    rows = index.rows(spark, np.flatnonzero(index.members > 0).tolist()).select("cell", F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind, kind_asked = number_type(rows.schema["v"].dataType), number_type(asked.schema["v"].dataType)

    @F.pandas_udf("struct<read:int,at:array<struct<b:int,cells:array<int>>>>")
    def places_of(questions: pd.Series) -> pd.DataFrame:
        found = []
        for q in questions:
            near, at = index.nearest(q, probe), {}
            for c in [*near, odd]:
                for block in range(start[c], start[c] + parts[c]):
                    at.setdefault(block, []).append(c)
            found.append((len(near), [{"b": block, "cells": cells} for block, cells in at.items()]))
        return pd.DataFrame(found, columns=["read", "at"])

    def matrix_of(vectors: pd.Series, kind: str) -> np.ndarray:
        m = np.zeros((len(vectors), max(map(len, vectors), default=0)), kind)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        return m

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cell = group["cell"].to_numpy("i8")
        return pd.DataFrame([{"b": key[0], "ids": group["id"].to_numpy("i8").tobytes(), "cells": np.where(cell == ODD, odd, cell).tobytes(), "m": matrix_of(group["v"], kind).tobytes()}])

    def packed_asked(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ends = np.cumsum([len(c) for c in group["cells"]])
        return pd.DataFrame([{"b": key[0], "prompts": group["prompt"].to_numpy("i8").tobytes(), "read": group["read"].to_numpy("i8").tobytes(), "ends": ends.astype("i8").tobytes(), "wanted": np.concatenate(list(group["cells"])).astype("i8").tobytes(), "q": matrix_of(group["v"], kind_asked).tobytes()}])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, cells, prompts, read = (np.frombuffer(x, "i8") for x in (r.ids, r.cells, r.prompts, r.read))
                ends, wanted = np.frombuffer(r.ends, "i8"), np.frombuffer(r.wanted, "i8")
                low = min(cells.min(), wanted.min())
                mask = np.zeros((len(prompts), max(cells.max(), wanted.max()) - low + 1), bool)
                mask[np.repeat(np.arange(len(prompts)), np.diff(ends, prepend=0)), wanted - low] = True
                q, m = np.frombuffer(r.q, kind_asked).reshape(len(prompts), -1), np.frombuffer(r.m, kind).reshape(len(ids), -1)
                for a in range(0, len(prompts), STRIP):
                    own = prompts[a : a + STRIP]
                    score = np.where(mask[a : a + STRIP, cells - low] & (own[:, None] != ids), cosines(q[a : a + STRIP], m), -np.inf)
                    least = np.partition(score, -k, axis=1)[:, -k, None] if len(ids) > k else -np.inf
                    i, j = np.nonzero((score >= least) & (score > -np.inf))
                    found = pd.DataFrame({"prompt": own[i], "id": ids[j], "score": score[i, j], "cells_read": read[a : a + STRIP][i]})
                    yield found.sort_values(["prompt", "score", "id"], ascending=[True, False, True]).groupby("prompt").head(k)

    blocks = rows.join(F.broadcast(places), "cell").withColumn("b", F.col("s") + F.pmod(F.xxhash64("id"), F.col("n"))).groupBy("b").applyInPandas(packed, "b long, ids binary, cells binary, m binary")
    asked = asked.where("v IS NOT NULL")
    spread = asked.select("prompt", "v", places_of("v").alias("p")).select("prompt", "v", "p.read", F.inline("p.at"))
    parts_asked = max(1, -(-asked.count() // BLOCK))
    questions = spread.withColumn("part", F.pmod(F.xxhash64("prompt"), F.lit(parts_asked))).groupBy("b", "part").applyInPandas(packed_asked, "b long, prompts binary, read binary, ends binary, wanted binary, q binary")
    with arrow_rows(spark, 4):  # a row holds two blocks
        found = cut(questions.join(blocks, "b").select("ids", "cells", "m", "prompts", "read", "ends", "wanted", "q").mapInPandas(best, "prompt long, id long, score double, cells_read long"))
    rank = F.row_number().over(W.partitionBy("prompt").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("prompt", "rank", "id", "score", "cells_read")


_built: dict[tuple[str, str], Cells] = {}


def chunk_cells(v: Views) -> Cells:
    """The index of the chunks' vectors, with what retrieval filters by; built once a session and folder of tables."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _built:
        rows = v.chunks.where("embedding IS NOT NULL").select("id", "doc_id", "chunk_type", "page", "embedding").join(v.docs.select("doc_id", "filename", "pages"), "doc_id")
        _built[key] = Cells.build(rows, f"{ensure_checkpoint_dir(v.spark)}/cells-{uuid.uuid4().hex}")
    return _built[key]


def question(v: Views) -> list[float]:
    """The vector of ``Views.question``; read from one row group, as ids are in order."""
    found = v.question.first()
    return list(found["q"]) if found else []


@query()
def cell_recall(v: Views, k: int = 20) -> DataFrame:
    """For every chunk whose id is divisible by 100: how many of its ``k`` nearest the probed cells hold, and how many cells."""
    index = chunk_cells(v)
    rows = index.rows(v.spark, list(range(len(index.members)))).select("id", "embedding")
    asked = cut(rows.where("id % 100 = 0").select(F.col("id").alias("prompt"), F.col("embedding").alias("v")))
    near = probed(index, asked, k)
    every = probed(index, asked, k, 1.0).select("prompt", "id")
    return near.join(every, ["prompt", "id"], "left_semi").groupBy("prompt").agg(F.count("*").alias("found"), F.first("cells_read").alias("cells_read")).withColumn("cells", F.lit(int((index.members > 0).sum())))


@query("WITH scored AS (SELECT id, doc_id, chunk_type, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM chunks, question WHERE embedding IS NOT NULL) SELECT id, doc_id, chunk_type, score FROM scored WHERE chunk_type = 'text' ORDER BY score DESC, id LIMIT 60")
def cell_topk(v: Views) -> DataFrame:
    """The best texts by the index, exactly."""
    return chunk_cells(v).top(v.spark, question(v), 60, F.col("chunk_type") == "text")[0].select("id", "doc_id", "chunk_type", "score")
