"""Toxicity by a linear classifier that is regularised with counterfactual group mentions."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.frames import labelled_sample, small_batches
from tessella.llm.hashing import Words

#: Groups that a sentence may name without being toxic (fixed values).
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners blacks whites asians africans "
    "arabs europeans americans gays lesbians straight trans disabled blind deaf old young poor rich "
    "frauen männer muslime christen juden ausländer flüchtlinge behinderte femmes hommes musulmans chrétiens juifs étrangers réfugiés "
    "mujeres hombres musulmanes cristianos judíos extranjeros refugiados"
).split()
WORD = re.compile(r"\w+")
#: Rows and characters of the training sample.
MAX_ROWS, MAX_CHARS = 4000, 32_000
#: Words that a worker remembers.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    min_docs: int = 3
    rounds: int = 150
    rate: float = 0.3
    l1: float = 3e-4
    counterfactual: float = 0.5
    terms: tuple[str, ...] = field(default=tuple(IDENTITY_TERMS))
    seed: int = 7


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each feature of each word, the word's number and the feature's hash: the whole word and its beginnings."""
    w = Words(words)
    parts = [(np.arange(len(words)), w.whole()), *map(w.prefixes, s.prefixes)]
    return np.concatenate([a for a, _ in parts]), (np.concatenate([h for _, h in parts]) >> np.uint64(64 - s.bits)).astype("i4")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swap_terms(words: set[str], terms: tuple[str, ...], rng: random.Random) -> tuple[set[str], set[str]]:
    """The words of a sentence with the groups it names, and with other groups in their place.

    A sentence that names none gets one, so that every labelled sentence says something about neutral mentions.
    """
    named = words & set(terms)
    if not named:
        named = {rng.choice(terms)}
    others = rng.sample([t for t in terms if t not in named], min(len(named), len(terms) - len(named)))
    return words | named, words - named | set(others)


def _counts(words: set[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's features, and how many distinct words have each."""
    _, found = features(list(words), s)
    ids, counts = np.unique(found, return_counts=True)
    return ids, counts.astype("f4")


def _rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, hashes and counts of texts, laid end to end."""
    rows = np.repeat(np.arange(len(parts), dtype="i4"), [len(ids) for ids, _ in parts])
    return rows, np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])


def train_toxicity(sample: list[tuple[str, int]], s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights by hash, and the bias, of a logistic model.

    The loss is the mean log loss over the sample, plus ``counterfactual`` times the mean squared difference between
    the logits of each sentence with its groups and with swapped groups, plus an L1 term. It is lowered by proximal
    steps with a rate of its own for each weight. Weights are not negative: a word may tell of toxicity or of nothing, so a
    long text is not cleared by many harmless words. With one class or no rows the weights are zero and the bias tells
    the share of label 1.
    """
    y = np.array([label for _, label in sample], "f8")
    weights = np.zeros(1 << s.bits)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(share / (1 - share))
    if len(set(y)) < 2:
        return weights, bias
    rng = random.Random(s.seed)
    texts, groups, others = [], [], []
    for text, _ in sample:  # only arrays are kept of a text
        words = words_of(text)
        own, swapped = swap_terms(words, s.terms, rng)
        texts.append(_counts(words, s))
        groups.append(_counts(own - swapped, s))
        others.append(_counts(swapped - own, s))
    rows, hashes, vals = _rows(texts)
    used = np.bincount(hashes, minlength=1 << s.bits) >= s.min_docs
    used[features(list(s.terms), s)[1]] = True
    column = np.cumsum(used) - 1
    fit = used[hashes]
    rows, cols, vals = rows[fit], column[hashes[fit]], vals[fit]
    (ar, ah, av), (br, bh, bv) = _rows(groups), _rows(others)
    dr, dc, dv = np.concatenate([ar, br]), column[np.concatenate([ah, bh])], np.concatenate([av, -bv])
    n, m = len(y), int(used.sum())
    w, seen, bias_seen = np.zeros(m), np.full(m, 1e-12), 1e-12
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, vals * w[cols], n), -40, 40)))
        apart = np.bincount(dr, dv * w[dc], n)
        grad = np.bincount(cols, vals * ((p - y) / n)[rows], m) + s.counterfactual * 2 / n * np.bincount(dc, dv * apart[dr], m)
        seen += grad**2
        step = s.rate / np.sqrt(seen)
        w = np.maximum(w - step * (grad + s.l1), 0)
        g = (p - y).mean()
        bias_seen += g * g
        bias -= s.rate * g / math.sqrt(bias_seen)
    weights[used] = w
    return weights, float(bias)


def toxicity_score(spark, weights: np.ndarray, bias: float, s: Settings = Settings()):
    """A column function: the score of a whole text, from 0 to 1. The model's size is fixed, so it is broadcast."""
    model = spark.sparkContext.broadcast((weights, bias))
    small_batches(spark)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = model.value
        known: dict[str, float] = {}
        for texts in batches:
            sets = [words_of(t or "") for t in texts]
            new = list({w for ws in sets for w in ws if w not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*sets))
            of, found = features(new, s)
            known.update(zip(new, np.bincount(of, weights[found], len(new)).tolist(), strict=True))
            # fsum rounds once, so the order of a set does not matter
            logits = [bias + math.fsum(map(known.__getitem__, ws)) for ws in sets]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, "f8"), -40, 40))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` with ``score`` (of label 1, from 0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The model is trained on a sample of at most ``max_rows`` rows of ``labels`` for which ``train`` holds, of texts of at
    most ``max_chars`` characters, so that the driver's share is bounded. Every
    whole text is scored, whatever its id. Null text counts as empty and scores by the bias alone. Repeated rows score
    alike; columns named ``score`` or ``predicted`` are replaced; an empty table gives an empty result.
    """
    weights, bias = train_toxicity(labelled_sample(docs, labels, "toxic", train, max_rows, max_chars, id_col, text_col), settings)
    scored = docs.withColumn("score", toxicity_score(docs.sparkSession, weights, bias, settings)(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
