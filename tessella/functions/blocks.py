"""Vectors that all meet each other, as matrix products of blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FloatType

from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut

#: Rows of a block at least and at most, and blocks that there should be for the tasks before blocks grow; rows that are multiplied at a time.
BLOCK, LARGEST, BLOCKS, STRIP = 1024, 8192, 32, 512
#: What single precision may be off by in the cosine of vectors of up to ``NARROW`` numbers, amply.
SLACK, NARROW = 1e-4, 1024


def number_type(vectors: DataType) -> str:
    """How a block holds numbers: as they are given, so floats in half the bytes of doubles."""
    return "<f4" if isinstance(vectors.elementType, FloatType) else "<f8"


def dealt(rows: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` (id, v, flag) dealt by a hash of the id into blocks (b, ids, flags, kind, m), and how many; ``m`` is a matrix, row by row.

    As every block meets every other, each row travels once for each block: so blocks grow with the rows, up to ``LARGEST``. Null
    vectors take no part; missing numbers of shorter vectors count as zero.
    """
    rows, kind = rows.where("v IS NOT NULL"), number_type(rows.schema["v"].dataType)
    n = rows.count()
    count = max(1, -(-n // (block or min(LARGEST, max(BLOCK, n // BLOCKS)))))

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        m = np.zeros((len(group), max(map(len, group["v"]), default=0)), kind)
        for i, v in enumerate(group["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame([{"b": key[0], "ids": group["id"].to_numpy("i8").tobytes(), "flags": group["flag"].to_numpy("i1").tobytes(), "kind": kind, "m": m.tobytes()}])

    groups = rows.select("id", "v", F.col("flag").cast("boolean").alias("flag"), F.pmod(F.xxhash64("id"), F.lit(count)).alias("b")).groupBy("b")
    return groups.applyInPandas(packed, "b long, ids binary, flags binary, kind string, m binary"), count


def paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in double precision and as wide as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x.astype("f8"), ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all of ``b``, to six decimals; 0 where a norm is 0."""
    a, b = paired(a, b)
    sizes = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return np.round(np.divide(a @ b.T, sizes, out=np.zeros_like(sizes), where=sizes > 0), 6)


def alike(least: float) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of two matrices: the numbers of the rows of both whose ``cosines`` are ``least`` or more.

    A product of unit vectors in single precision leaves out what is surely below; the rest is worked out in double precision.
    """

    def found(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = paired(a, b)
        sizes, sizes2 = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        if least <= 2 * SLACK or a.shape[1] > NARROW:
            return np.nonzero(cosines(a, b) >= least)
        unit = lambda m, size: np.divide(m, size[:, None], out=np.zeros_like(m), where=(size > 0)[:, None]).astype("f4")
        i, j = np.nonzero(unit(a, sizes) @ unit(b, sizes2).T >= least - SLACK)
        product = sizes[i] * sizes2[j]
        exact = np.round(np.divide(np.einsum("ij,ij->i", a[i], b[j]), product, out=np.zeros(len(i)), where=product > 0), 6) >= least
        return i[exact], j[exact]

    return found


def meet(pairs: DataFrame, found: Callable[..., pd.DataFrame], schema: str, score: Callable = cosines) -> DataFrame:
    """``found(ids, ids2, flags2, score)`` for each pair of blocks (ids, kind, m, ids2, flags2, kind2, m2), by strips of the first's rows.

    Rows are in the order of ids, and those of an id are in one strip.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b, flags = np.frombuffer(r.ids, "i8"), np.frombuffer(r.ids2, "i8"), np.frombuffer(r.flags2, "?")
                m, m2 = np.frombuffer(r.m, r.kind).reshape(len(a), -1), np.frombuffer(r.m2, r.kind2).reshape(len(b), -1)
                starts = np.unique(np.searchsorted(a, a[::STRIP]))
                for k, end in zip(starts, [*starts[1:], len(a)], strict=True):
                    yield found(a[k:end], b, flags, score(m[k:end], m2))

    with arrow_rows(pairs.sparkSession, 4):  # a row holds two blocks
        return cut(pairs.select("ids", "kind", "m", "ids2", "flags2", "kind2", "m2").mapInPandas(run, schema))


def asked_of_all(asked: DataFrame, rows: DataFrame, found: Callable[..., pd.DataFrame], schema: str, block: int | None = None, score: Callable = cosines) -> DataFrame:
    """A stated set of queries (id, v) against all ``rows`` (id, v, flag), in blocks."""
    left, _ = dealt(asked.withColumn("flag", F.lit(False)), block)
    right, count = dealt(rows, block)
    spread = left.select("ids", "kind", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("b2"))
    return meet(spread.join(second(right), "b2"), found, schema, score)


def second(blocks: DataFrame) -> DataFrame:
    """``blocks`` as the other side of pairs, to be joined on ``b2``.

    The join is never a broadcast: Spark does not count that the first side is repeated for each block, takes it for as small as
    its rows once, and would gather all of it on the driver.
    """
    return blocks.select(F.col("b").alias("b2"), *[F.col(c).alias(f"{c}2") for c in ("ids", "flags", "kind", "m")]).hint("merge")
