"""Ranked lexical search: hashed sketches of greatest impacts bound scores, exact scores follow in the order of the bounds."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import mul
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessella.llm.words import word_blocks
from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut

K = 20
#: Coordinates of a sketch, and texts of an Arrow batch: a task holds the sketches of one batch.
COORDINATES, BATCH = 4096, 256
#: Items of a block and characters of their texts, about: what is sent to all tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 1024, 1 << 22
#: Ranks last among equal scores, after any id.
NO_ID = -(2**63) - 1


def counted(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a text."""
    return Counter(chain.from_iterable(word_blocks(text)))


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What a document adds to a score for each unit of a term's weight: a saturating share of its occurrences."""
    return 10**9 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Items of a block: their terms with repeats, and, once counts are known, weights and the table of lookups."""

    def __init__(self, texts: list[bytes]):
        self.terms = [sorted(counted(t).items()) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for terms in self.terms for t, _ in terms}))}

    def weigh(self, n_docs: int, df: list[int], coordinates: int) -> None:
        at = {t: weight(n_docs, df[i]) for t, i in self.vocabulary.items()}
        self.weights = [[n * at[t] for t, n in terms] for terms in self.terms]
        self.names = [[t for t, _ in terms] for terms in self.terms]
        self.lookups = np.zeros((coordinates, len(self.terms)))
        for q, (names, weights) in enumerate(zip(self.names, self.weights, strict=True)):
            for t, w in zip(names, weights, strict=True):
                self.lookups[crc32(t) % coordinates, q] += w

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds on the score of each document (row) for each item; what rounding could take away is added."""
        return (sketches @ self.lookups) * (1 + 1e-9)


class Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.threshold, self.k = np.ones(items, "i8"), k  # a score of 0 is no hit

    def add(self, q: int, score: int, after: int) -> None:
        heap = self.heaps[q]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, after))
        else:
            heapq.heappushpop(heap, (score, after))
        if len(heap) == self.k:
            self.threshold[q] = heap[0][0]


def sketch(counts: Counter[bytes], impact: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinatewise maxima of the impacts of the terms that a hash sends to each coordinate."""
    out = np.zeros(coordinates)
    np.maximum.at(out, np.fromiter(map(crc32, counts), "i8", len(counts)) % coordinates, impact)
    return out


def rescore(block: Block, best: Best, ids: list[int | None], counts: list[Counter[bytes]], impact: list[np.ndarray], bounds: np.ndarray) -> int:
    """Exact scores in descending order of the bounds, for each item until no bound reaches its threshold; how many were taken.

    A bound equal to the threshold is still looked at, as a tie may go to a smaller id.
    """
    exact: dict[int, dict[bytes, int]] = {}
    taken = 0
    for q in np.flatnonzero((bounds >= best.threshold).any(axis=0)).tolist():
        near = np.flatnonzero(bounds[:, q] >= best.threshold[q])
        for i in near[np.argsort(-bounds[near, q], kind="stable")].tolist():
            if bounds[i, q] < best.threshold[q]:
                break
            taken += 1
            if i not in exact:
                exact[i] = dict(zip(counts[i], impact[i].tolist(), strict=True))
            score = sum(map(mul, block.weights[q], map(exact[i].get, block.names[q], repeat(0))))
            if score >= best.threshold[q]:
                best.add(q, score, NO_ID if ids[i] is None else -ids[i])
    return taken


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = K, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``(<item>, rank, <doc>, score)``: the ``k`` best documents of each item by its terms' weights and the documents' impacts.

    Items go in blocks of bounded size; for each block, one pass counts the documents and those that hold each of its terms, and
    one searches. In a search, each document's impacts fold into a sketch: a coordinate holds the greatest impact of the
    terms hashed to it, so that a batch's sketches times a table of the items' weights give upper bounds for all
    items at once. Documents are then scored exactly in descending order of their bounds, until the bound of the next is below
    the ``k``-th score so far. Thresholds go on from batch to batch; each task sends at most ``k`` rows an item, and a window
    merges them. No text is shuffled, and every document is bounded for every item.

    Ids are whole numbers. Ties go to the smaller id, a null id comes last. Null text has no terms, and documents without
    terms count for nothing; rows that repeat an id are documents of their own. Rows that repeat an item's id and text are one item; an
    item without terms has no results. Empty tables give an empty result. Further columns are not used.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["chars"] or 0) // block_chars))
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item string, item_id {kind}, id long, score long")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (str(r["item_id"]), r["text"]))
        if not rows:
            continue
        found = found.union(_search_block(texts, Block([r["text"].encode() for r in rows]), [r["item_id"] for r in rows], kind, k, coordinates, b))
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(texts: DataFrame, block: Block, item_ids: list, kind: str, k: int, coordinates: int, number: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(len(block.vocabulary), "i8"), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = counted(text)
                docs, terms = docs + bool(counts), terms + counts.total()
                df[[block.vocabulary[t] for t in block.vocabulary.keys() & counts.keys()]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([docs, terms, *df[held].tolist()], pa.int64())], ["term", "n"])

    spark = texts.sparkSession
    with arrow_rows(spark, BATCH):
        counts = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
    block.weigh(n_docs, [counts.get(i, 0) for i in range(len(block.vocabulary))], coordinates)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(item_ids), k)
        for batch in batches:
            ids, held, impact = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if terms := counted(text):
                    ids.append(i)
                    held.append(terms)
                    impact.append(impacts(np.fromiter(terms.values(), "i8", len(terms)), 75 + 25 * terms.total() * n_docs // n_terms))
            if ids:
                sketches = np.stack([sketch(c, x, coordinates) for c, x in zip(held, impact, strict=True)])
                rescore(block, best, ids, held, impact, block.bounds(sketches))
        hits = [(q, score, after) for q, heap in enumerate(best.heaps) for score, after in heap]
        columns = ([f"{number}.{q}" for q, _, _ in hits], [item_ids[q] for q, _, _ in hits], [None if a == NO_ID else -a for _, _, a in hits], [s for _, s, _ in hits])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = StructType.fromDDL(f"item string, item_id {kind}, id long, score long")
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])
    with arrow_rows(spark, BATCH):
        return cut(texts.mapInArrow(search, kinds))
