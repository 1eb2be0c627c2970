"""Importance resampling: documents drawn towards the distribution of a target's hashed word runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import BLOCK, word_blocks
from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut

BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Texts of an Arrow batch.
BATCH = 500
#: Random keys that a round of the selection counts by.
PIVOTS = 32


def features(text: bytes, runs: int = RUNS, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text, its number of words and the CRC-32 of every run of 1 to ``runs`` words that ends in it.

    A run's CRC goes on from that of the run without its last word.
    """
    held: list[bytes] = []
    for new in word_blocks(text, block):
        words = held + new
        spaced = [b" " + w for w in words]
        level = list(map(crc32, words))
        found = [level[len(held) :]]
        for j in range(1, runs):
            level = list(map(crc32, spaced[j:], level))
            found.append(level[max(0, len(held) - j) :])
        yield len(new), np.fromiter(chain.from_iterable(found), "u4", sum(map(len, found)))
        held = words[max(0, len(words) - runs + 1) :]


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, runs: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends at most one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, "i8")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, hashes in features(text, runs):
                    seen += np.bincount(hashes % buckets, minlength=buckets)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(seen[held])], ["bucket", "n"])

    with arrow_rows(texts.sparkSession, BATCH):
        rows = as_bytes(texts, text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, "i8")
    for r in rows:
        total[r["bucket"]] = r["n"]
    return total


def as_bytes(texts: DataFrame, text_col: str, *ids: Column) -> DataFrame:
    """The texts that are not null, or, with ids, all of them."""
    text = F.col(text_col).cast("binary")
    return texts.select(*ids, F.coalesce(text, F.lit(b"")).alias("text")) if ids else texts.where(text.isNotNull()).select(text.alias("text"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the logarithm of its smoothed share in the target over that in the source."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], "i8")


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS):
    """The ``k``-th smallest (from 1) of the column ``key``, a struct that no two rows share: a distributed quickselect.

    Each round takes random keys of the range that is left and counts, in one aggregation, the rows below and at each of
    them; the range then lies between two neighbours. All that reaches the driver are the keys and counts of a round.
    """
    low = high = None
    kinds = [(f.name, f.dataType) for f in keys.schema["key"].dataType]
    literal = lambda row: F.struct(*[F.lit(row[name]).cast(kind).alias(name) for name, kind in kinds])
    for seed in range(2**31):
        left = keys
        if low is not None:
            left = left.where(F.col("key") > literal(low))
        if high is not None:
            left = left.where(F.col("key") < literal(high))
        picked = [r["key"] for r in left.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(pivots).collect()]
        counts = [F.struct(F.count_if(F.col("key") < literal(p)).alias("below"), F.count_if(F.col("key") == literal(p)).alias("at")).alias(f"c{i}") for i, p in enumerate(picked)]
        parts = sorted(((c["below"], c["at"], p) for c, p in zip(left.agg(*counts).first(), picked, strict=True)), key=lambda x: x[0])
        for below, at, p in parts:
            if below < k <= below + at:
                return p
        under = [x for x in parts if x[0] + x[1] < k]
        high = next((p for below, _, p in parts if below >= k), high)
        if under:
            below, at, low = under[-1]
            k -= below + at
    raise AssertionError("a range shrinks in every round")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the order of ``key``, over sorted ranges and without one task for all of them."""
    runs = cut(rows.repartitionByRange(key).sortWithinPartitions(key)).withColumn("pid", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id())
    counts, before, at = sorted(map(tuple, runs.groupBy("pid").count().collect())), [], 0
    for pid, n in counts:
        before.append((pid, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "pid int, before long")  # a row for each partition
    place = F.col("mid").bitwiseAND((1 << 33) - 1)  # a row's number within its partition
    return runs.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("before") + place + 1).drop("pid", "mid", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, runs: int = RUNS, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """``(<id>, n_features, weight, score, rank)`` of every document; ``rank`` is null where it is not drawn.

    Features are runs of 1 to ``runs`` words, hashed into ``buckets``. Two passes over ``docs``: one counts the buckets, one adds
    up each document's gains from an array of them. A Gumbel variate from the id and the seed turns weights into scores, so that
    the ``percent`` highest scores are a draw without replacement. The last drawn key is found by ``kth_key``; only what is
    drawn is sorted and ranked, in ranges.

    What the driver and each task hold are arrays of ``buckets`` numbers. Null text has no words; a null id is hashed like
    an empty one and comes last among equal scores. Rows that repeat an id are documents of their own, ties between them
    broken by a row number. Documents of fewer than ``least_words`` words are scored but not drawn. An empty table
    gives an empty result, an empty target even shares. Columns other than the two named are not used.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, runs), bucket_counts(target, target_col, buckets, runs))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), "i8")
            for i, text in enumerate(batch.column(1).to_pylist()):
                for words, hashes in features(text, runs):
                    sums[:, i] += (words, len(hashes), gain[hashes % buckets].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["id", "words", "n", "weight"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    with arrow_rows(docs.sparkSession, BATCH):
        scored = cut(as_bytes(docs, text_col, F.col(id_col).alias("id")).mapInArrow(weigh, f"id {kind}, words long, n long, weight long").withColumn("score", F.col("weight") + gumbel))
    key = F.struct((-F.col("score")).alias("score"), F.col("id").isNull().alias("none"), "id", "row").alias("key")
    keyed = scored.withColumn("row", F.monotonically_increasing_id()).withColumn("key", key)  # the rows are fixed in the checkpoint
    able = F.col("words") >= least_words
    out = ["id", "n", "weight", "score", "rank"]
    k = percent * keyed.where(able).count() // 100
    if k:
        last = kth_key(keyed.where(able).select("key"), k)
        bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in keyed.schema["key"].dataType])
        drawn = able & (F.col("key") <= bound)
        keyed = ranked(keyed.where(drawn), "key").select(out).union(keyed.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(out))
    else:
        keyed = keyed.withColumn("rank", F.lit(None).cast("long"))
    return keyed.select(F.col("id").alias(id_col), F.col("n").alias("n_features"), "weight", "score", "rank")
