"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit, a naive Bayes
log-ratio over hashed byte n-grams, tells the languages with +1 from those with -1. A text is
given to the language whose codeword has the least loss: the logistic loss of each bit's
margin, weighted by how well that bit did on calibration texts of that language. If the
runner-up is within ``ambiguity`` of the winner, the text is flagged.

Fitting uses a bounded sample: at most about ``per_label`` learning texts of a language.
Prediction reads whole texts in bounded pieces, without a shuffle.

Defined results: null text or text without a letter: ``und``, score 0, not ambiguous; nothing
to learn from: ``und`` for all; one language: always that one; unknown letters only: the
loss of zero margins, ties go to the first language by name. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import (
    bag_sums,
    class_sample,
    class_shares,
    fold_of,
    ngram_keys,
    padded,
    raw_text,
    spans_of,
)

ORDERS = (2, 3)
BITS = 15
_PARTS = 8


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per class: all splits for few classes, else a well-spread random code."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        return np.array([[1] * len(splits)] + [1 - 2 * ((splits >> i) & 1) for i in range(k - 1)])
    length = math.ceil(10 * math.log2(k))
    rng = np.random.default_rng(seed)
    best, widest = None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], size=(k, length))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        apart = (length - code @ code.T) // 2
        np.fill_diagonal(apart, length)
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best


@dataclass
class LanguageModel:
    labels: list[str]
    code: np.ndarray
    table: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        sums, counts = bag_sums(texts, ORDERS, BITS, self.table)
        return sums / np.maximum(counts, 1)[:, None] * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0.0, -self.code[None] * margins[:, None, :])
        return (loss * self.weights[None]).sum(axis=2)

    def predict(self, texts: list[bytes], ambiguity: float) -> pd.DataFrame:
        if not self.labels:
            n = len(texts)
            und = pd.Series(["und"] * n, dtype=object)
            return pd.DataFrame({"lang_pred": und, "score": np.zeros(n), "ambiguous": np.zeros(n, bool)})
        loss = self.losses(self.margins(texts))
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        odds = np.exp(4.0 * (loss.min(axis=1, keepdims=True) - loss))
        rows = np.arange(len(texts))
        close = np.zeros(len(texts), bool)
        if len(self.labels) > 1:
            close = loss[rows, order[:, 1]] - loss[rows, best] < ambiguity
        return pd.DataFrame(
            {
                "lang_pred": pd.Series([self.labels[i] for i in best], dtype=object),
                "score": 1.0 / odds.sum(axis=1),
                "ambiguous": close,
            }
        )


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit_language(
    learning: DataFrame,
    label: str = "lang",
    per_label: int = 3000,
    most_bytes: int = 32 << 20,
) -> LanguageModel:
    """Learn from ``doc_id``, ``text`` and ``label``; rows with a null label are left out."""
    rows = learning.where(F.col(label).isNotNull() & _has_letter("text"))
    shares = class_shares(rows, label, per_label, most_bytes)
    labels = list(shares)
    code = codewords(len(labels))
    if len(labels) < 2:
        empty = np.zeros((1 << BITS, code.shape[1]), np.float32)
        return LanguageModel(labels, code, empty, np.ones(code.shape[1]), np.ones(code.shape))
    sample = (
        class_sample(rows, label, shares)
        .select(
            F.col(label).alias("label"),
            raw_text().alias("raw"),
            (F.pmod(F.xxhash64(F.lit("calibrate"), "text"), F.lit(4)) == 0).alias("held"),
        )
        .repartition(_PARTS)
    )
    counts = np.zeros((len(labels), 1 << BITS))
    for row in sample.where("not held").mapInPandas(_count, "label string, counts binary").collect():
        counts[labels.index(row["label"])] += np.frombuffer(row["counts"], np.int32)
    rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    plus = np.stack([rates[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])], axis=1)
    minus = np.stack([rates[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])], axis=1)
    table = np.log(plus / minus).astype(np.float32)
    model = LanguageModel(labels, code, table, np.ones(code.shape[1]), np.ones(code.shape))
    return _calibrated(model, sample.where("held"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, np.ndarray] = {}
    for pdf in batches:
        for name, group in pdf.groupby("label"):
            held = found.setdefault(name, np.zeros(1 << BITS, np.int32))
            for buf, _, _, cut in spans_of([padded(x) for x in group["raw"]]):
                data = np.frombuffer(buf, np.uint8)
                for order in ORDERS:
                    key, at = ngram_keys(data, order, BITS)
                    held += np.bincount(key[at < cut], minlength=1 << BITS).astype(np.int32)
    yield pd.DataFrame(
        {"label": list(found), "counts": [x.tobytes() for x in found.values()]}, dtype=object
    )


def _calibrated(model: LanguageModel, held: DataFrame) -> LanguageModel:
    """Scale the bits' margins alike and weigh each bit by its hits per language."""

    def hits(batches):
        bits = model.code.shape[1]
        n = np.zeros(len(model.labels))
        right = np.zeros((len(model.labels), bits))
        size = np.zeros(bits)
        for pdf in batches:
            margins = model.margins([padded(x) for x in pdf["raw"]])
            own = np.array([model.labels.index(x) for x in pdf["label"]], int)
            np.add.at(n, own, 1)
            np.add.at(right, own, model.code[own] * margins > 0)
            size += np.abs(margins).sum(axis=0)
        yield pd.DataFrame({"n": [n.tolist()], "right": [right.ravel().tolist()], "size": [size.tolist()]})

    rows = held.mapInPandas(
        hits, "n array<double>, right array<double>, size array<double>"
    ).collect()
    n = sum((np.array(r["n"]) for r in rows), np.zeros(len(model.labels)))
    right = sum((np.array(r["right"]) for r in rows), np.zeros(model.code.size))
    size = sum((np.array(r["size"]) for r in rows), np.zeros(model.code.shape[1]))
    accuracy = (right.reshape(model.code.shape) + 1.0) / (n + 2.0)[:, None]
    weights = np.maximum(accuracy - 0.5, 0.02)
    model.weights = weights / weights.sum(axis=1, keepdims=True)
    model.scale = 3.0 / np.maximum(size / max(1.0, n.sum()), 1e-6)
    if n.sum() == 0:
        model.scale = np.full(model.code.shape[1], 10.0)
    return model


def predict_language(docs: DataFrame, model: LanguageModel, ambiguity: float = 0.15) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every document, from its text alone."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            yield model.predict([padded(x) for x in raw], ambiguity)

    named = docs.select("doc_id", _has_letter("text").alias("_l"), predict(raw_text()).alias("_p"))
    return named.select(
        "doc_id",
        F.when(F.col("_l"), F.col("_p.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("_l"), F.col("_p.score")).otherwise(0.0).alias("score"),
        (F.col("_l") & F.col("_p.ambiguous")).alias("ambiguous"),
    )


def identify_language(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Fit on the documents outside the held-out fold, predict for all."""
    fold = fold_of("doc_id", parts)
    model = fit_language(docs.where(fold != held).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select(
        "doc_id", (fold == held).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
