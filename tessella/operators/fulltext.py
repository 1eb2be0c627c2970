"""German full-text search: a positional inverted index as a table sorted by term, and searches that read only their terms' lists."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions.german import STEMS_SQL, term
from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import ensure_checkpoint_dir
from tessella.registry import query
from tessella.sources.views import Views

WORD = re.compile(r"[^\W_]+")
#: Texts of an Arrow batch, and bytes of a row group: small, so that a term's list is few of them.
BATCH, GROUP_BYTES = 500, 4 << 20
#: Rows of a file of the index, about.
FILE_ROWS = 500_000
POSTINGS = "term string, id long, positions array<int>"


def postings(texts: DataFrame) -> DataFrame:
    """``(term, id, positions)`` of ``texts`` (id, text): where, counted in words from 1, each term stands in each text.

    Words are runs of letters and digits, lower-cased; stop words count as places but have no list. Texts are read whole;
    null and empty ones have no terms.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words: dict[str, list[int]] = {}
                for at, word in enumerate(WORD.findall(text), 1):
                    words.setdefault(word, []).append(at)
                held: dict[str, list[int]] = {}
                for word, places in words.items():  # a word is stemmed once a text, however often it stands there
                    if (t := term(word)) is not None:
                        held[t] = sorted(held[t] + places) if t in held else places
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([i] * len(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int32()))], ["term", "id", "positions"])

    return texts.select(F.col("id").cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(listed, POSTINGS)


def write_index(texts: DataFrame, path: str) -> None:
    """The index of ``texts`` (id, text) as Parquet in ``path``, in the order of its terms.

    It is dealt by ranges of term and id, so the list of a frequent term lies in several files, and sorted within, so that the
    statistics of files and row groups tell a reader which hold a term. Ranges are found on the rows themselves, which are read
    twice for that: so they are written beside the index first, and texts are taken apart once.
    """
    spark, dealt = texts.sparkSession, f"{ensure_checkpoint_dir(texts.sparkSession)}/postings-{uuid.uuid4().hex}"
    with arrow_rows(spark, BATCH):
        postings(texts).write.parquet(dealt)
    rows = spark.read.schema(POSTINGS).parquet(dealt)
    files = max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILE_ROWS))
    rows.repartitionByRange(files, "term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", GROUP_BYTES).parquet(path)


class Part(NamedTuple):
    """A word or a phrase: its terms and how far from its beginning they stand."""

    terms: tuple[str, ...]
    offsets: tuple[int, ...]


def part(words: str) -> Part | None:
    held = [(t, n) for n, w in enumerate(WORD.findall(words.lower())) if (t := term(w)) is not None]
    return Part(*map(tuple, zip(*held, strict=True))) if held else None


def parsed(asked: str) -> list[tuple[list[Part], list[Part]]]:
    """Alternatives, parted by ``or``, each with what it wants and what it excludes: words, and phrases in quotes.

    Stop words are not looked for; in a phrase they keep their places.
    """
    found: list[tuple[list[Part], list[Part]]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', asked):
        if word.lower() == "or" and not minus:
            found.append(([], []))
        elif (p := part(phrase or word)) is not None:
            found[-1][bool(minus)].append(p)
    return [x for x in found if x[0]]


@F.pandas_udf(DoubleType())
def nearness(places: pd.Series) -> pd.Series:
    """Sum over neighbouring parts, given as sorted lists of places, of 1 over 1 more than their least distance."""

    def one(lists) -> float:
        out = 0.0
        for a, b in zip(lists, lists[1:], strict=False):
            if len(a) and len(b):
                at = np.searchsorted(b, a)
                after, before = b[np.minimum(at, len(b) - 1)], b[np.maximum(at - 1, 0)]
                out += 1 / (1 + int(np.minimum(abs(after - a), abs(a - before)).min()))
        return out

    return places.map(one)


def search(index: DataFrame, asked: str, k: int = 300, sparse: int = 20) -> DataFrame:
    """``(id, matched, score, lexical_rank)``: texts with all of an alternative; if fewer than ``sparse``, those with any part too.

    Texts are ranked by how many parts they hold, then by a score: for each part its frequency, as ``1 - 1 / (1 + tf)``, for
    neighbouring parts their nearness; then by id. What an alternative excludes keeps a text from that alternative, and what any
    excludes from the rest. Only lists of the asked terms are read and shuffled. Rows that repeat an id are one text. A search
    without words finds nothing.
    """
    alternatives = parsed(asked)
    wanted = list(dict.fromkeys(p for want, _ in alternatives for p in want))
    excluded = list(dict.fromkeys(p for _, out in alternatives for p in out))
    terms = sorted({t for p in wanted + excluded for t in p.terms})
    if not wanted:
        return index.where("false").selectExpr("id", "0 AS matched", "0.0D AS score", "0 AS lexical_rank")
    held = index.where(F.col("term").isin(terms))
    lists = held.groupBy("id").agg(*[F.array_sort(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions"))))).alias(f"t{n}") for n, t in enumerate(terms)])

    def places(p: Part) -> Column:
        begins = lambda offset: lambda place: place - offset
        return reduce(F.array_intersect, [F.transform(f"t{terms.index(t)}", begins(n)) for t, n in zip(p.terms, p.offsets, strict=True)])

    every = [*wanted, *excluded]
    found = lists.select("id", *[places(p).alias(f"p{n}") for n, p in enumerate(every)])
    has = {p: F.size(f"p{n}") > 0 for n, p in enumerate(every)}
    all_of = lambda conditions: reduce(Column.__and__, conditions)
    full = reduce(Column.__or__, (all_of([has[p] for p in want] + [~has[p] for p in out]) for want, out in alternatives))
    some = all_of([reduce(Column.__or__, (has[p] for p in wanted)), *(~has[p] for p in excluded)])
    matched = sum((has[p].cast("int") for p in wanted), F.lit(0))
    often = sum((1 - 1 / (1 + F.size(f"p{n}")) for n in range(len(wanted))), F.lit(0.0))
    near = nearness(F.array(*[f"p{n}" for n in range(len(wanted))])) if len(wanted) > 1 else F.lit(0.0)
    hits = found.withColumn("full", full).where(F.col("full") | some).select("id", "full", matched.alias("matched"), F.round(often + near, 6).alias("score"))
    enough = hits.agg((F.count_if("full") >= sparse).alias("enough"))
    order = [F.desc("matched"), F.desc("score"), F.col("id")]
    best = hits.crossJoin(F.broadcast(enough)).where("full OR NOT enough").select("id", "matched", "score").orderBy(*order).limit(k)  # one row
    return best.withColumn("lexical_rank", F.row_number().over(W.orderBy(*order)))


_written: dict[tuple[str, str], str] = {}


def chunk_index(v: Views) -> DataFrame:
    """The index of the chunks' texts and captions, written once a session and folder of tables, as ingestion would."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _written:
        path = f"{ensure_checkpoint_dir(v.spark)}/fulltext-{uuid.uuid4().hex}"
        write_index(v.chunks.select("id", F.concat(F.coalesce("content_text", F.lit("")), F.lit(" "), F.coalesce("caption", F.lit(""))).alias("text")), path)
        _written[key] = path
    return v.spark.read.schema(POSTINGS).parquet(_written[key])


ASKED = 'the "and the" ened -ofa'

STEMMED = f"""tok AS (SELECT id, list_filter(string_split_regex(lower(coalesce(content_text, '') || ' ' || coalesce(caption, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM chunks),
    pos AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM tok), voc AS (SELECT DISTINCT w FROM pos), {STEMS_SQL}"""
LEXICAL = f"""{STEMMED}, lists AS (SELECT id, list(pos ORDER BY pos) FILTER (t = 'the') AS a, list(pos ORDER BY pos) FILTER (t = 'and') AS b, list(pos ORDER BY pos) FILTER (t = 'ened') AS c, count(*) FILTER (t = 'ofa') AS x FROM pos JOIN stems USING (w) WHERE t IN ('the', 'and', 'ened', 'ofa') GROUP BY id),
    parts AS (SELECT id, coalesce(a, []) AS a, list_filter(coalesce(b, []), lambda p: list_contains(a, p + 1)) AS b, coalesce(c, []) AS c FROM lists WHERE x = 0),
    near AS (SELECT *, list_min(list_transform(a, lambda p: list_min(list_transform(b, lambda q: abs(p - q))))) AS ab, list_min(list_transform(b, lambda p: list_min(list_transform(c, lambda q: abs(p - q))))) AS bc FROM parts),
    tf AS (SELECT id, (a <> [])::INT + (b <> [])::INT + (c <> [])::INT AS matched, round(0.0 + (1 - 1 / (1 + len(a))::DOUBLE) + (1 - 1 / (1 + len(b))::DOUBLE) + (1 - 1 / (1 + len(c))::DOUBLE) + (coalesce(1 / (1 + ab)::DOUBLE, 0) + coalesce(1 / (1 + bc)::DOUBLE, 0)), 6) AS score FROM near),
    lexical AS (SELECT id, matched, score, row_number() OVER (ORDER BY matched DESC, score DESC, id) AS lexical_rank FROM tf WHERE matched = 3 OR matched > 0 AND (SELECT count(*) FROM tf WHERE matched = 3) < 20 QUALIFY lexical_rank <= 300)"""


@query(f"WITH {LEXICAL} SELECT id, matched, score, lexical_rank FROM lexical WHERE lexical_rank <= 50")
def lexical_topk(v: Views) -> DataFrame:
    return search(chunk_index(v), ASKED, 50)


@query(f"WITH {STEMMED} SELECT t AS term, count(DISTINCT id) AS texts, count(*) AS occurrences, sum(pos)::BIGINT AS places FROM pos JOIN stems USING (w) GROUP BY t")
def term_statistics(v: Views) -> DataFrame:
    """Every term of the index: texts, occurrences and the sum of its places."""
    size = F.size("positions")
    return chunk_index(v).groupBy("term").agg(F.count_distinct("id").alias("texts"), F.sum(size).alias("occurrences"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("places"))
