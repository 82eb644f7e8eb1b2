"""Toxicity by a bag of subword embeddings averaged into a linear softmax.

A text is the bag of the hashed character n-grams (3 to 5 bytes, with word ends) of its words.
Their embeddings are averaged, weighted by share, and a linear softmax gives the probability
of label 1. Embeddings and softmax are trained jointly in numpy, so a misspelling that was
never seen shares most of its n-gram vectors with the word it stands for.

Fitting uses a bounded sample: at most about ``per_label`` learning texts and ``most_bytes``
bytes per label, chosen by hash. Scoring reads whole texts in bounded pieces, without a
shuffle.

Defined results: a null or empty text has an empty bag and the score of the bare bias; rows
with a null label are not learned from; if the labels hold fewer than two classes, the score
is the share of label 1 among them (0 without labels); repeated rows are scored alike. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import (
    bag_of,
    bag_sums,
    fold_of,
    light_rows,
    padded,
    raw_text,
    sampled_texts,
)
from evalweave.session import materialise

ORDERS = (3, 4, 5)
BITS = 16
DIM = 8
#: Averages over a whole text are small; this brings them to the size of a logit.
GAIN = 50.0


@dataclass
class ToxicityModel:
    """``logit`` holds, per n-gram, its embedding times the difference of the softmax rows."""

    logit: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        sums, counts = bag_sums(texts, ORDERS, BITS, self.logit[:, None])
        margin = GAIN * sums[:, 0] / np.maximum(counts, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def train(
    bags: Sequence[tuple[np.ndarray, np.ndarray]],
    labels: Sequence[int],
    epochs: int = 10,
    rate: float = 0.1,
    decay: float = 1e-6,
    seed: int = 11,
) -> ToxicityModel:
    """Joint gradient steps (Adagrad) on embeddings and softmax, classes weighted alike."""
    y = np.asarray(labels, int)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    soft = (rng.standard_normal((2, DIM)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_e = np.full(1 << BITS, 1e-4, np.float32)
    seen_s, seen_b = np.full((2, DIM), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    for epoch in range(epochs):
        step = rate * (1.0 - 0.9 * epoch / epochs)
        for i in rng.permutation(len(y)):
            at, share = bags[i]
            mean = GAIN * (share @ embed[at])
            z = soft @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= weight[y[i]]
            back = soft.T @ p
            g_soft = np.outer(p, mean)
            seen_s += g_soft**2
            seen_b += p**2
            soft -= step * g_soft / np.sqrt(seen_s)
            bias -= step * p / np.sqrt(seen_b)
            scaled = GAIN * share
            seen_e[at] += scaled**2 * float(back @ back)
            embed[at] -= np.outer(step * scaled / np.sqrt(seen_e[at]), back) + decay * embed[at]
    turn = soft[1] - soft[0]
    return ToxicityModel((embed @ turn).astype(np.float32), float(bias[1] - bias[0]))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = 2000,
    most_bytes: int = 12 << 20,
) -> ToxicityModel:
    """Learn from the documents (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    Only ids, sizes and labels are joined. Several labels of one id count as their largest.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y"))
    light = materialise(light_rows(docs).join(known, "doc_id"), "labelled")
    sample, _ = sampled_texts(docs, light, "y", per_label, most_bytes)
    bags = [bag_of(padded(x), ORDERS, BITS) for x in sample["raw"]]
    return train(bags, sample["y"].tolist())


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for every document, from its text alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series(model.score([padded(x) for x in raw]))

    scored = docs.select("doc_id", score(raw_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Fit on labelled documents outside the held-out fold, score all."""
    fold = fold_of("doc_id", parts)
    model = fit_toxicity(docs.where(fold != held).select("doc_id", "text"), labels)
    return score_toxicity(docs, model).select(
        "doc_id", (fold == held).alias("held_out"), "score", "predicted"
    )
