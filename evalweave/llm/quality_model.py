"""Quality classifier from weak labels.

Heuristic labellers, several per kind of junk so that they overlap, each fire or stay silent
on a text. Expectation-maximisation estimates how often each fires on good and on bad texts
(its accuracy) and the share of good texts, from the counts of firing patterns over all
documents: at most two to the number of labellers cells. The posterior of a text's pattern is
its soft label. Posterior labels of a bounded sample train a linear scorer on hashed
features of the text (trigrams of character shapes, and coarse levels of the statistics),
which then decides for every document.

No human label is read. The sample has at most about ``per_class`` texts and ``most_bytes``
bytes on either side of posterior 0.5, weighted back to their shares in the corpus.

Defined results: a null text counts as empty; a text without words fires no labeller and is
scored like any other; with one pattern only, posterior and score are the same for all;
an empty table gives no rows; repeated rows are scored alike. Other columns are kept by
``with_quality`` and ignored by ``classify_quality``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import (
    fresh,
    light_rows,
    ngram_keys,
    raw_text,
    sampled_texts,
    spans_of,
)
from evalweave.session import materialise

BITS = 13
_LEVELS = 64
_ORDER = (3,)

#: Lower case to a, upper case to A, digits to 0, white space to a blank; other signs stay.
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57
    else 32 if b in b" \t\n\x0b\x0c\r" else b
    for b in range(256)
)
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_RUNS = re.compile(rb"aa+")

#: Shares of a text that labellers test, all from 0 to 1.
STATISTICS = (
    "signs",  # of characters
    "signed_words",  # words that end in two signs or more
    "upper",  # of ASCII letters
    "loud_words",  # words that end in !!
    "bare_signs",  # words of signs only
    "distinct",  # distinct words of all words
    "top_word",  # the most frequent word
    "repeats",  # words equal to the word before
    "short_words",  # words of up to three bytes
)

#: (statistic, test, limit): fires if the share is above (+) or below (-) the limit.
LABELLERS = (
    ("signs", "+", 0.15),
    ("signed_words", "+", 0.3),
    ("upper", "+", 0.5),
    ("loud_words", "+", 0.3),
    ("bare_signs", "+", 0.25),
    ("short_words", "-", 0.1),
    ("distinct", "-", 0.25),
    ("top_word", "+", 0.25),
    ("repeats", "+", 0.3),
)
#: Texts of fewer words say too little for a labeller.
_LEAST_WORDS = 20


def statistics(raw: bytes) -> tuple[list[float], int]:
    """The shares of one text, and its number of words."""
    words = raw.split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    counts = Counter(words)
    bare = [w.rstrip(_SIGNS) for w in words]
    return [
        (len(raw) - len(raw.translate(None, _SIGNS))) / chars,
        sum(len(w) - len(b) >= 2 for w, b in zip(words, bare, strict=True)) / n,
        upper / max(1, upper + lower),
        sum(w.endswith(b"!!") for w in words) / n,
        sum(not b for b in bare) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(len(b) <= 3 for b in bare if b) / n,
    ], len(words)


def votes(raw: bytes) -> int:
    """One bit per labeller that fires."""
    shares, n = statistics(raw)
    if n < _LEAST_WORDS:
        return 0
    held = dict(zip(STATISTICS, shares, strict=True))
    return sum(
        1 << i
        for i, (name, way, limit) in enumerate(LABELLERS)
        if (held[name] > limit if way == "+" else held[name] < limit)
    )


def label_model(
    patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200
) -> tuple[dict[int, float], np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, firing rates on bad, on good, share of good).

    Two classes, labellers independent given the class; start: labellers fire on bad texts.
    Pseudo-counts keep rates off 0 and 1, so an idle labeller or an empty table is no problem.
    """
    keys = np.array(sorted(patterns) or [0])
    n = np.array([patterns.get(int(k), 0) for k in keys], float)
    fires = ((keys[:, None] >> np.arange(labellers)) & 1).astype(float)
    bad, good, prior = np.full(labellers, 0.4), np.full(labellers, 0.02), 0.85
    post = np.ones(len(keys))
    for _ in range(rounds):
        like_good = np.log(prior) + fires @ np.log(good) + (1 - fires) @ np.log1p(-good)
        like_bad = np.log1p(-prior) + fires @ np.log(bad) + (1 - fires) @ np.log1p(-bad)
        post = 1.0 / (1.0 + np.exp(np.clip(like_bad - like_good, -50, 50)))
        n_good, n_bad = n * post, n * (1 - post)
        good = (n_good @ fires + 0.1) / (n_good.sum() + 10.0)
        bad = (n_bad @ fires + 2.0) / (n_bad.sum() + 5.0)
        prior = (n_good.sum() + 9.0) / (n.sum() + 10.0)
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), bad, good, float(prior)


def _level_keys(raw: bytes) -> np.ndarray:
    """Hashed coarse levels of the statistics, in a range of their own after the trigrams."""
    shares, n = statistics(raw)
    if n < _LEAST_WORDS:
        return np.empty(0, np.int64)
    steps = [min(_LEVELS // 8 - 1, int(x * (_LEVELS // 8))) for x in shares]
    return (1 << BITS) + np.array([i * (_LEVELS // 8) + s for i, s in enumerate(steps)])


_WIDTH = (1 << BITS) + len(STATISTICS) * (_LEVELS // 8)


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: square roots of the trigrams' shares, and the levels."""
    shape = b" " + b" ".join(_RUNS.sub(b"aa", raw.translate(_SHAPE)).split()) + b" "
    counts = np.zeros(1 << BITS, np.int64)
    for buf, _, _, cut in spans_of([shape]):
        data = np.frombuffer(buf, np.uint8)
        for order in _ORDER:
            key, at = ngram_keys(data, order, BITS)
            counts += np.bincount(key[at < cut], minlength=1 << BITS)
    found = np.flatnonzero(counts)
    share = np.sqrt(counts[found] / max(1, counts.sum()))
    levels = _level_keys(raw)
    return np.concatenate([found, levels]), np.concatenate([share, np.full(len(levels), 0.3)])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    posterior: dict[int, float]

    def score(self, raw: bytes) -> float:
        at, value = features(raw)
        margin = float(value @ self.weights[at]) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))))


def train_scorer(
    texts: list[bytes], soft: np.ndarray, weight: np.ndarray, epochs: int = 12, seed: int = 5
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad steps."""
    weights, seen = np.zeros(_WIDTH), np.full(_WIDTH, 1e-3)
    bias, seen_bias = 0.0, 1e-3
    held = [features(t) for t in texts]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = 0.2 * (1 - epoch / epochs)
        for i in rng.permutation(len(held)):
            at, value = held[i]
            margin = np.clip(value @ weights[at] + bias, -40, 40)
            slope = weight[i] * (1.0 / (1.0 + np.exp(-margin)) - soft[i])
            g = slope * value
            seen[at] += g**2
            seen_bias += slope**2
            weights[at] -= step * g / np.sqrt(seen[at]) + 1e-6 * weights[at]
            bias -= step * slope / np.sqrt(seen_bias)
    return weights, float(bias)


def _votes(text: Column) -> Column:
    @F.pandas_udf("int")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([votes(x) for x in raw], dtype="int32")

    return vote(text)


def fit_quality(docs: DataFrame, per_class: int = 2500, most_bytes: int = 12 << 20) -> QualityModel:
    """Fit on the firing patterns of all ``docs`` and a bounded sample of their texts."""
    voted = materialise(light_rows(docs, _votes(raw_text()).alias("votes")), "votes")
    patterns = {
        r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    }
    posterior, *_ = label_model(patterns)
    side = (_chance(F.col("votes"), posterior) >= 0.5).cast("int")
    held, shares = sampled_texts(docs, voted.withColumn("y", side), "y", per_class, most_bytes)
    weight = np.array([1.0 / shares[y] for y in held["y"]])
    weight = weight / max(1e-9, weight.mean()) if len(weight) else weight
    soft = np.array([posterior[v] for v in held["votes"]])
    weights, bias = train_scorer(held["raw"].tolist(), soft, weight)
    return QualityModel(weights, bias, posterior)


def _chance(pattern: Column, posterior: dict[int, float]) -> Column:
    pairs = [F.lit(x) for k, p in posterior.items() for x in (k, p)]
    return F.element_at(F.create_map(*pairs), pattern)


def with_quality(docs: DataFrame, model: QualityModel, name: str = "quality") -> DataFrame:
    """Adds struct ``name``: votes, posterior, score."""

    @F.pandas_udf("votes int, posterior double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            found = [votes(x) for x in raw]
            yield pd.DataFrame(
                {
                    "votes": np.array(found, "int32"),
                    "posterior": [model.posterior.get(v, 0.5) for v in found],
                    "score": [model.score(x) for x in raw],
                }
            )

    return docs.withColumn(name, judge(raw_text()))


def keep_good(docs: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    name = fresh(docs, "_quality")
    scored = with_quality(docs, fit_quality(docs, **fit), name)
    return scored.where(F.col(f"{name}.score") >= least).drop(name)


def classify_quality(docs: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """doc_id, votes, posterior, score, kept for every document."""
    scored = with_quality(docs.select("doc_id", "text"), fit_quality(docs, **fit), "q")
    return scored.select("doc_id", "q.*", (F.col("q.score") >= least).alias("kept"))
