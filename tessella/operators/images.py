"""Images as grids of grey values: scaled down by area averages, for thumbnails and difference hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessella.functions.vectors import unit
from tessella.operators.duplicates import dhash
from tessella.registry import query
from tessella.sources.views import Views

#: The longest side that images keep, and how often it is halved at most; sides of thumbnails.
MAX_SIDE, HALVINGS, THUMB = 1024, 4, 16
IMAGE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", ArrayType(IntegerType()))])


def _summed(m: np.ndarray, cells: int) -> np.ndarray:
    """Sums along the first axis over ``cells`` equal stretches, a value that a border cuts counting by its part.

    Sums are in units of ``1 / cells`` of a value, so all numbers are whole: running sums up to a border are taken from the summed
    table, and of the value that the border cuts as much as lies before it.
    """
    n = len(m)
    table = np.concatenate([np.zeros((1, *m.shape[1:]), "i8"), np.cumsum(m, axis=0, dtype="i8")])
    whole, rest = np.divmod(np.arange(cells + 1) * n, cells)
    cut = np.concatenate([m, np.zeros((1, *m.shape[1:]), m.dtype)])[whole].astype("i8")
    return np.diff(table[whole] * cells + cut * rest.reshape(-1, *[1] * (m.ndim - 1)), axis=0)


def area_average(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    """``grid`` scaled to ``height`` rows of ``width``: each new value is the mean of the area that it covers, halves rounded up."""
    sums = _summed(_summed(grid, height).T, width).T
    size = grid.size
    return (2 * sums + size) // (2 * size)


def halved(grid: np.ndarray, side: int = MAX_SIDE, most: int = HALVINGS) -> np.ndarray:
    """``grid`` with both sides halved until the longer is ``side`` at most, ``most`` times at most; a block at an edge may be smaller."""
    longest, n = max(grid.shape), 0
    while longest >> n > side and n < most:
        n += 1
    if not n:
        return grid
    step = 1 << n
    rows, cols = np.arange(0, grid.shape[0], step), np.arange(0, grid.shape[1], step)
    sums = np.add.reduceat(np.add.reduceat(grid.astype("i8"), rows, axis=0), cols, axis=1)
    counts = np.outer(np.diff([*rows, grid.shape[0]]), np.diff([*cols, grid.shape[1]]))
    return (2 * sums + counts) // (2 * counts)


def _each(images: pd.DataFrame, f) -> pd.DataFrame:
    """``f`` of each image that has pixels, as rows of ``IMAGE``; a null or empty image, or one whose size does not fit, is null."""
    out = []
    for w, h, p in zip(images["width"], images["height"], images["pixels"], strict=True):
        fits = p is not None and w == w and h == h and len(p) and len(p) == int(w) * int(h)
        if not fits:
            out.append((None, None, None))
            continue
        grid = f(np.asarray(p, "i8").reshape(int(h), int(w)))
        out.append((grid.shape[1], grid.shape[0], grid.ravel().tolist()))
    return pd.DataFrame(out, columns=["width", "height", "pixels"], dtype=object)


def resized(image: Column, width: int, height: int) -> Column:
    """An image (``IMAGE``) scaled to a size."""
    return F.pandas_udf(lambda x: _each(x, lambda g: area_average(g, width, height)), IMAGE)(image)


def shrunk(image: Column, side: int = MAX_SIDE) -> Column:
    """An image (``IMAGE``) halved as often as its longest side asks for."""
    return F.pandas_udf(lambda x: _each(x, lambda g: halved(g, side)), IMAGE)(image)


def with_thumbnail(rows: DataFrame, image: str, name: str = "thumbnail", side: int = THUMB) -> DataFrame:
    """``rows`` with the direction of each image: its thumbnail over its norm; null for a black one."""
    small = rows.withColumn("_small", resized(F.col(image), side, side))
    return small.withColumn(name, unit(F.col("_small.pixels"))).drop("_small")


def with_difference_hash(rows: DataFrame, image: str, name: str = "h") -> DataFrame:
    """``rows`` with 64 bits of each image on a grid of 9 by 8."""
    small = rows.withColumn("_small", resized(F.col(image), 9, 8))
    return small.withColumn(name, dhash(F.col("_small.pixels"), 9, 8)).drop("_small")


def text_images(v: Views) -> DataFrame:
    """Every document's text as an image: its bytes row by row, as wide as high, the last row filled with black."""

    @F.pandas_udf(IMAGE)
    def image(texts: pd.Series) -> pd.DataFrame:
        out = []
        for b in texts:
            n = len(b or b"")
            w = int(np.floor(np.sqrt(n)))
            h = -(-n // w) if n else 0
            out.append((w, h, np.frombuffer(b.ljust(w * h, b"\0"), "u1").astype("i4").tolist() if n else []))
        return pd.DataFrame(out, columns=["width", "height", "pixels"], dtype=object)

    return v.table("documents").select("doc_id", image(F.col("text").cast("binary")).alias("image"))


def scaled_texts(rows: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (id, bytes) as (id, width, height, and for each size its pixels): bytes row by row as wide as high, as ``text_images``.

    A text's image is as many times its bytes in numbers, so it is made and scaled in one step, text by text, and only the small ones
    leave it; null and empty texts are left out.
    """

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, data in zip(batch["id"], batch["bytes"], strict=True):
                raw = data.as_buffer() if data.is_valid else b""
                n = len(raw)
                if n:
                    w = math.isqrt(n)
                    h = -(-n // w)
                    grid = np.zeros(w * h, "u1")
                    grid[:n] = np.frombuffer(raw, "u1")
                    grid = grid.reshape(h, w)
                    found.append((i.as_py(), w, h, *(area_average(grid, *size).ravel().tolist() for size in sizes)))
            columns = list(zip(*found, strict=True)) if found else [[]] * (3 + len(sizes))
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * len(sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "width", "height", *[f"p{k}" for k in range(len(sizes))]])

    return rows.select(F.col("id").cast("long").alias("id"), "bytes").mapInArrow(scaled, "id long, width int, height int, " + ", ".join(f"p{k} array<int>" for k in range(len(sizes))))


@query("""WITH s AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
    d AS (SELECT *, floor(sqrt(n))::BIGINT AS wide, (n + floor(sqrt(n))::BIGINT - 1) // floor(sqrt(n))::BIGINT AS high FROM s),
    p AS (SELECT doc_id, wide, high, i % wide AS x, i // wide AS y, ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT AS p FROM (SELECT *, unnest(range(n)) AS i FROM d)),
    t(w, h) AS (VALUES (9, 8), (16, 16)),
    a AS (SELECT doc_id, wide, high, w, h, y, p, x, unnest(range((x * w) // wide, ((x + 1) * w - 1) // wide + 1)) AS i FROM p, t),
    b AS (SELECT doc_id, wide, high, w, h, y, i, sum(p * (least((x + 1) * w, (i + 1) * wide) - greatest(x * w, i * wide)))::BIGINT AS s FROM a GROUP BY ALL),
    c AS (SELECT *, unnest(range((y * h) // high, ((y + 1) * h - 1) // high + 1)) AS j FROM b),
    e AS (SELECT doc_id, wide, high, w, h, i, j, ((2 * sum(s * (least((y + 1) * h, (j + 1) * high) - greatest(y * h, j * high)))::BIGINT + wide * high) // (2 * wide * high))::BIGINT AS v FROM c GROUP BY doc_id, wide, high, w, h, i, j),
    f AS (SELECT g.doc_id, g.wide, g.high, g.w, g.h, cell % g.w AS i, cell // g.w AS j, coalesce(e.v, 0) AS v FROM (SELECT doc_id, wide, high, w, h, unnest(range(w * h)) AS cell FROM d, t) g
        LEFT JOIN e ON e.doc_id = g.doc_id AND e.w = g.w AND e.h = g.h AND e.i = cell % g.w AND e.j = cell // g.w),
    bits AS (SELECT doc_id, string_agg(CASE WHEN l.v < r.v THEN '1' ELSE '0' END, '' ORDER BY l.j, l.i) AS bits FROM f l JOIN f r USING (doc_id, w, h, j) WHERE w = 9 AND r.i = l.i + 1 GROUP BY doc_id),
    m AS (SELECT doc_id, any_value(wide)::INT AS width, any_value(high)::INT AS height, md5(string_agg(v, ',' ORDER BY j, i)) AS thumb_md5 FROM f WHERE w = 16 GROUP BY doc_id)
    SELECT doc_id, width, height, bits, thumb_md5 FROM m JOIN bits USING (doc_id)""")
def image_scaling(v: Views) -> DataFrame:
    """Difference hash, as bits, and thumbnail of every document's image."""
    rows = scaled_texts(v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("bytes")), [(9, 8), (THUMB, THUMB)])
    bits = F.reverse(F.lpad(F.bin(dhash(F.col("p0"), 9, 8)), 64, "0"))
    return rows.select(F.col("id").alias("doc_id"), "width", "height", bits.alias("bits"), F.md5(F.encode(F.array_join("p1", ","), "utf-8")).alias("thumb_md5"))
