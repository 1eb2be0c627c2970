"""Quality by supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import labelled_sample, small_batches
from tessella.llm.hashing import Words

#: Rows and characters of the training sample.
MAX_ROWS, MAX_CHARS = 4000, 32_000
#: Words that a worker remembers.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Settings:
    bits: int = 17
    dims: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 3
    rate: float = 0.5
    seed: int = 11


def word_features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature of each word the word's number and the bucket, and the words' hashes.

    A word's features are itself and its character n-grams between marks of begin and end.
    """
    w = Words([f"<{x}>" for x in words])
    parts = [(np.arange(len(words)), w.whole()), *map(w.grams, s.grams)]
    buckets = (np.concatenate([h for _, h in parts]) >> np.uint64(64 - s.bits)).astype("i4")
    return np.concatenate([a for a, _ in parts]), buckets, parts[0][1]


def pair_features(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of neighbouring words; a word and itself share one bucket, as repetition tells more than the word."""
    a, b = hashes[:-1], hashes[1:]
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - s.bits)
    return np.where(a == b, np.uint64(1), mixed).astype("i4")


def _document(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and each one's share of all its features."""
    _, own, hashes = word_features(words, s)
    found = np.concatenate([own, pair_features(hashes, s)])
    ids, counts = np.unique(found, return_counts=True)
    return ids, counts / max(len(found), 1)


def train_quality(sample: list[tuple[str, int]], s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """For each bucket the difference its vector makes to the two softmax outputs, and the difference of the biases.

    Vectors and output weights are learned together by stochastic gradient descent, a document a step, at a rate that
    falls to zero. At scoring time only ``vector @ (out[1] - out[0])`` of a bucket matters, so that is what is kept.
    With one class or no rows, the differences are zero and the bias tells the share of label 1.
    """
    rng = np.random.default_rng(s.seed)
    y = np.array([label for _, label in sample], "i8")
    share = (y.sum() + 0.5) / (len(y) + 1)
    vectors, out, bias = rng.uniform(-1 / s.dims, 1 / s.dims, (1 << s.bits, s.dims)), np.zeros((2, s.dims)), np.log([1 - share, share])
    if len(set(y.tolist())) == 2:
        docs = [_document(text.split(), s) for text, _ in sample]
        steps, step = s.epochs * len(y), 0
        for _ in range(s.epochs):
            for i in rng.permutation(len(y)):
                rate = s.rate * (1 - step / steps)
                step += 1
                ids, shares = docs[i]
                own = vectors[ids]
                hidden = shares @ own
                z = out @ hidden + bias
                e = np.exp(z - z.max())
                err = e / e.sum()
                err[y[i]] -= 1
                # a step on the mean is spread over all vectors; dividing by the largest share keeps words audible
                vectors[ids] = own - rate * np.outer(shares / max(shares.max(initial=0), 1e-9), err @ out)
                out -= rate * np.outer(err, hidden)
                bias -= rate * 0.1 * err
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def quality_score(spark, buckets: np.ndarray, bias: float, s: Settings = Settings()):
    """A column function: the score of a whole text, from 0 to 1. The model's size is fixed, so it is broadcast."""
    model = spark.sparkContext.broadcast((buckets, bias))
    small_batches(spark)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, bias = model.value
        place: dict[str, int] = {}
        sums, counts, hashes = np.empty(0), np.empty(0), np.empty(0, "u8")
        for texts in batches:
            docs = [(t or "").split() for t in texts]
            new = list(dict.fromkeys(w for words in docs for w in words if w not in place))
            if len(place) + len(new) > REMEMBERED:
                place.clear()
                sums, counts, hashes = sums[:0], counts[:0], hashes[:0]
                new = list(dict.fromkeys(w for words in docs for w in words))
            of, found, own = word_features(new, s)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            sums = np.concatenate([sums, np.bincount(of, buckets[found], len(new))])
            counts = np.concatenate([counts, np.bincount(of, minlength=len(new))])
            hashes = np.concatenate([hashes, own])
            logits = []
            for words in docs:
                ids = np.fromiter(map(place.__getitem__, words), "i8", len(words))
                pairs = pair_features(hashes[ids], s)
                n = counts[ids].sum() + len(pairs)
                logits.append(bias + (sums[ids].sum() + buckets[pairs].sum()) / max(n, 1))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, "f8"), -40, 40))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` with ``score`` (of label 1, from 0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The model is trained on a sample of at most ``max_rows`` rows of ``labels`` for which ``train`` holds, of texts of at
    most ``max_chars`` characters, so that the driver's share is bounded. Every
    whole text is scored, whatever its id. Null text counts as empty and scores by the bias alone. Repeated rows score
    alike; columns named ``score`` or ``predicted`` are replaced; an empty table gives an empty result.
    """
    buckets, bias = train_quality(labelled_sample(docs, labels, "quality", train, max_rows, max_chars, id_col, text_col), settings)
    scored = docs.withColumn("score", quality_score(docs.sparkSession, buckets, bias, settings)(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
