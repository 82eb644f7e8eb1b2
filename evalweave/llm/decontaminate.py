"""Benchmark decontamination: BM25 over an inverted index of test items, then overlap.

Index: items are cut into parts of at most 64 words. A part's BM25 weights are divided by their
sum, so a passage scores the share of the part's own BM25 score that it holds, and one
threshold fits all. Postings are in order of part; beside each stand the highest weight of its
term in the same block of 16 parts and, per term, the highest of all.

Query, block-max WAND: every passage (``passage`` words, one every ``stride``) of every document
has a cursor in the postings of each of its terms. Terms are put in order of the part they
stand at, and the first part up to which their highest weights add up to the threshold is the
pivot: no part before it can be a hit. Cursors before the pivot skip to it by binary search.
If the block maxima at the pivot stay below the threshold, all cursors leave the block; else the
pivot is scored exactly, in integers. Bounds are rounded up, so they are safe. Thousands of passages
take each of these steps together. All parts at or above the threshold are candidates, with no
limit on their number. ``least`` is positive: a part without a common term is never a hit.

Verification: around the passage, the share of the item's question and of its answer whose
pairs of words occur must both reach ``overlap``. Every passage at or above the threshold is
verified in its own region until the best verified one of an item is known. Without columns ``question`` and
``answer`` an item's last sentence is its answer, and of a single sentence the last third.

Defined results: null texts count as empty; an empty document has no hits; an item without
words is never hit; repeated items (same id and text) are one, other items of one id each
count, and a document is reported once per item id with the best values; repeated documents
are reported each as one (doc_id, item_id); empty tables give no rows. Item ids may have any
type that a string can be cast back to; they keep it. Other columns are ignored by
``find_leaks`` and kept by ``drop_leaks``.

Scale: items are a query set: parts go to the workers in shards of about 16,384, some ten MB
each, and documents are scanned once per shard without a shuffle, so once for any benchmark up to that size;
document frequencies are counted over all parts first. Long documents are read in bounded
chunks, and the text of a long item is stored once beside its parts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import LETTERS, fresh, quoted, raw_text
from evalweave.session import materialise

_PART, _BLOCK = 64, 16
_K1, _B = 1.2, 0.75
_CHUNK = 1 << 12
# Upper bounds are counted in 1 / _UNIT. A part and a bound share 31 bits, so a shard has fewer than 2**16 parts.
_BITS, _UNIT, _MOST_PARTS = 15, 1 << 14, 1 << 16
# Weights are whole numbers too, so a sum does not depend on its order or on the batch.
_WEIGHT = 1 << 40
_BATCH, _SLICE = 1 << 13, 1 << 10
_ENDS = re.compile(r"[.!?]\s+|\n+")


def words_of(text: str) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """Parts of nearly equal length, of at most 64 words."""
    n = math.ceil(len(words) / _PART)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer) words."""
    text = (text or "").strip()
    for end in reversed([m.end() for m in _ENDS.finditer(text)]):
        question, answer = words_of(text[:end]), words_of(text[end:])
        if question and answer:
            return question, answer
    words = words_of(text)
    at = len(words) - len(words) // 3
    return words[:at], words[at:]


def pairs_of(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


class Places:
    """Where the pairs of ``wanted`` begin in the words from ``low`` to ``high``; found once for
    all regions of an item."""

    def __init__(self, wanted: list[bytes], words: list[bytes], low: int, high: int):
        number = {p: i for i, p in enumerate(pairs_of(wanted))}
        self.need = len(number)
        self.width = min(2, len(wanted))
        part = words[low:high]
        stream = zip(part, part[1:], strict=False) if self.width == 2 else part
        found = [(at, number[p]) for at, p in enumerate(stream, low) if p in number]
        self.at, self.which = np.array(found, np.int64).reshape(-1, 2).T

    def share(self, low: int, high: int) -> float:
        """The share of the pairs that stand in the words from ``low`` to ``high``."""
        if not self.need:
            return 1.0
        a, b = np.searchsorted(self.at, [low, high - self.width + 1])
        return len(np.unique(self.which[a:b])) / self.need


def passages_of(ids: np.ndarray, passage: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, terms): the distinct terms of every passage, largest first, filled with zeros."""
    n = len(ids)
    begin = np.arange(0, max(1, n - passage + stride), stride)
    place = begin[:, None] + np.arange(passage)
    # A term counts once in a passage: where it last stood before the passage.
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    again = np.flatnonzero(ids[order][1:] == ids[order][:-1]) + 1
    before[order[again]] = order[again - 1]
    inside = place < n
    place = np.minimum(place, n - 1)
    terms = np.where(inside & (before[place] < begin[:, None]), ids[place], 0)
    return begin, -np.sort(-terms, axis=1)


@dataclass
class ItemIndex:
    """The inverted index of one shard of parts.

    The postings of a term end with one at the part ``n``, which does not exist.
    """

    terms: dict[bytes, int] = field(default_factory=dict)
    starts: np.ndarray | None = None  # per term, the first posting
    highest: np.ndarray | None = None  # per term, the bound of all its weights
    parts: np.ndarray | None = None
    weights: np.ndarray | None = None
    in_block: np.ndarray | None = None  # per posting, the bound of the term's weights in the block
    places: np.ndarray | None = None  # per posting, term * (n + 1) + part, ascending
    owner: list[int] = field(default_factory=list)
    items: list[tuple] = field(default_factory=list)

    def _skip(self, at: np.ndarray, part: np.ndarray, to: np.ndarray) -> None:
        """Move the cursors that stand before ``to`` to the first posting at or after it."""
        moving = np.flatnonzero(part < to[:, None])
        to = to[moving // part.shape[1]]
        # Most lists are short: one step first, a binary search for what has further to go.
        found = at.ravel()[moving] + 1
        far = np.flatnonzero(self.parts[found] < to)
        width = len(self.owner) + 1
        term = self.places[found[far]] // width
        found[far] = np.searchsorted(self.places, term * width + to[far])
        at.ravel()[moving] = found
        part.ravel()[moving] = self.parts[found]

    def hits(self, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, score) of all parts that score ``least`` or more; a row of ``terms`` is a query."""
        rows, parts, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        n_terms = (terms > 0).sum(axis=1)
        order = np.argsort(n_terms, kind="stable")
        for low in range(0, len(order), _SLICE):
            row = order[low : low + _SLICE]
            for r, p, x in self._walk(terms[row, : n_terms[row[-1]]], least):
                rows.append(row[r])
                parts.append(p)
                scores.append(x)
        return np.concatenate(rows), np.concatenate(parts), np.concatenate(scores)

    def _walk(self, terms: np.ndarray, least: float) -> Iterator[tuple]:
        n, need = len(self.owner), int(least * _UNIT)
        row, at = np.arange(len(terms)), np.take(self.starts, terms)
        highest, part = np.take(self.highest, terms), np.take(self.parts, at)
        turn = 0
        while len(row):
            key = np.sort((part << _BITS) | highest, axis=1)
            reach = np.cumsum(key & ((1 << _BITS) - 1), axis=1)
            nth = (reach < need).sum(axis=1)
            live = np.flatnonzero(nth < key.shape[1])
            pivot = key[live, nth[live]] >> _BITS
            live, pivot = live[pivot < n], pivot[pivot < n]
            if len(live) < len(row):
                row, at, highest, part = row[live], at[live], highest[live], part[live]
            self._skip(at, part, pivot)
            ends = pivot // _BLOCK * _BLOCK + _BLOCK
            bound = np.where(part < ends[:, None], self.in_block[at], 0).sum(axis=1)
            score_it = bound >= need
            full = np.flatnonzero(score_it)
            score = np.where(part[full] == pivot[full, None], self.weights[at[full]], 0).sum(axis=1)
            score = np.round(score / _WEIGHT, 9)
            yield row[full[score >= least]], pivot[full[score >= least]], score[score >= least]
            self._skip(at, part, np.minimum(np.where(score_it, pivot + 1, ends), n).astype(np.int32))
            turn += 1
            if turn % 8 == 0 and len(row):  # columns in which every cursor is at the end go
                left = int((part < n).sum(axis=1).max())
                if left < part.shape[1]:
                    keep = np.argsort(part, axis=1)[:, :left]
                    at, highest, part = (
                        np.ascontiguousarray(np.take_along_axis(x, keep, 1)) for x in (at, highest, part)
                    )


def build_index(
    rows: list[tuple[int, str, str | None, str | None]],
    parts: list[tuple[int, list[bytes]]],
    frequency: dict[bytes, int],
    n_parts: int,
    mean_length: float,
) -> ItemIndex:
    """rows: (item id, text, question, answer); parts: (index into rows, words)."""
    index = ItemIndex()
    postings: dict[bytes, list[tuple[int, float]]] = {}
    for number, (item, words) in enumerate(parts):
        index.owner.append(item)
        norm = _K1 * (1 - _B + _B * len(words) / mean_length)
        weight = {}
        for w in words:
            weight[w] = weight.get(w, 0) + 1
        for w, tf in weight.items():
            df = frequency[w]
            weight[w] = math.log1p((n_parts - df + 0.5) / (df + 0.5)) * tf * (_K1 + 1) / (tf + norm)
        whole = sum(weight.values())
        for w, x in weight.items():
            postings.setdefault(w, []).append((number, x / whole))
    for item, text, question, answer in rows:
        if question is None or answer is None:
            index.items.append((item, *split_item(text)))
        else:
            index.items.append((item, words_of(question), words_of(answer)))
    n = len(parts)
    if n >= _MOST_PARTS:
        raise ValueError("a shard holds fewer than 65,536 parts; take more shards")
    index.terms = {w: i + 1 for i, w in enumerate(postings)}  # 0: a word of no item
    lists = [[], *postings.values()]
    sizes = np.array([len(p) + 1 for p in lists])
    index.starts = np.cumsum(sizes) - sizes
    term = np.repeat(np.arange(len(lists)), sizes)
    index.parts = np.array([k for p in lists for k in (*[k for k, _ in p], n)], np.int32)
    weights = np.array([x for p in lists for x in (*[x for _, x in p], 0.0)])
    index.weights = np.rint(weights * _WEIGHT).astype(np.int64)
    index.places = term * (n + 1) + index.parts
    bound = np.ceil(index.weights * (_UNIT / _WEIGHT)).astype(np.int32)
    index.highest = np.maximum.reduceat(bound, index.starts)
    # The last posting, at the part n, is a block of its own.
    block = np.where(index.parts < n, index.parts // _BLOCK, -1)
    first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)])
    most = np.maximum.reduceat(bound, first)
    index.in_block = np.repeat(most, np.diff(np.r_[first, len(term)]))
    return index


def _verify(found: dict, held: dict, item: tuple, words: list[bytes], passage: int, overlap: float) -> None:
    """Put the best verified passage of an item in ``found``. held: place -> score."""
    name, question, answer = item
    length = len(question) + len(answer)
    low, high = max(0, min(held) - length), min(len(words), max(held) + passage + length)
    asked, told = Places(question, words, low, high), Places(answer, words, low, high)
    # The highest score first, on a tie the first place, until one is verified.
    for at, score in sorted(held.items(), key=lambda x: (-x[1], x[0])):
        if name in found and score <= found[name][0]:
            break
        ends = max(0, at - length), min(len(words), at + passage + length)
        q, a = asked.share(*ends), told.share(*ends)
        if q >= overlap and a >= overlap:
            found[name] = (score, q, a, at)
            break


def leaks_of(
    raws: Iterable[bytes], index: ItemIndex, passage: int, stride: int, least: float, overlap: float
) -> Iterator[dict]:
    """item id -> (score, question overlap, answer overlap, word place) of each document in turn."""
    get = index.terms.get
    waiting: list[dict] = []
    pieces: list[tuple] = []

    def settle() -> None:
        if not pieces:
            return
        ends = np.cumsum([len(p[2]) for p in pieces])
        rows, parts, scores = index.hits(np.concatenate([p[3] for p in pieces]), least)
        seen: dict[tuple[int, int], dict[int, float]] = {}
        which = np.searchsorted(ends, rows, side="right")
        for k, r, part, score in zip(which.tolist(), rows.tolist(), parts.tolist(), scores.tolist(), strict=True):
            places = pieces[k][2]
            held = seen.setdefault((k, index.owner[part]), {})
            place = int(places[r - int(ends[k]) + len(places)])
            held[place] = max(score, held.get(place, 0.0))
        for (k, item), held in sorted(seen.items()):
            _verify(pieces[k][0], held, index.items[item], pieces[k][1], passage, overlap)
        pieces.clear()

    n = 0
    for raw in raws:
        words = raw.translate(LETTERS).split()
        found: dict = {}
        waiting.append(found)
        for base in range(0, len(words), _CHUNK):
            ids = np.array([get(w, 0) for w in words[base : base + _CHUNK + passage]], np.int32)
            if ids.any():
                begin, terms = passages_of(ids, passage, stride)
                pieces.append((found, words, base + begin, terms))
                n += len(begin)
            if n >= _BATCH:
                settle()
                n = 0
        if not pieces:
            yield from waiting
            waiting = []
        n += 1  # documents without a known word wait, too
    settle()
    yield from waiting


def leaks_in(raw: bytes, index: ItemIndex, passage: int, stride: int, least: float, overlap: float) -> dict:
    return next(leaks_of([raw], index, passage, stride, least, overlap))


def item_indexes(benchmark: DataFrame, shard_parts: int = 1 << 14) -> Iterator[ItemIndex]:
    """The index of every shard. One shard of items at a time is on the driver."""
    extra = [c if c in benchmark.columns else None for c in ("question", "answer")]
    items = materialise(
        benchmark.select(
            F.col("item_id").cast("string").alias("item"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            *[
                (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(n)
                for c, n in zip(extra, "qa", strict=True)
            ],
        )
        .distinct()
        .withColumn("key", F.xxhash64("item", "text", "q", "a")),
        "items",
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (key, k, [w.decode() for w in part])
                for key, text in zip(pdf["key"], pdf["text"], strict=True)
                for k, part in enumerate(parts_of(words_of(text)))
            ]
            yield pd.DataFrame(out, columns=["key", "part", "words"])

    parts = materialise(
        items.select("key", "text").mapInPandas(cut, "key long, part int, words array<string>"), "parts"
    )
    n, mean = parts.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    if not n:
        return
    shards = math.ceil(n / shard_parts)
    shard = F.pmod(F.xxhash64("key", "part"), F.lit(shards))
    terms = parts.select(shard.alias("s"), F.explode(F.array_distinct("words")).alias("w"))
    counts = terms.groupBy("w").count()
    per_shard = materialise(terms.distinct().join(counts, "w"), "terms")
    for s in range(shards):
        own = parts.where(shard == s)
        number: dict[int, int] = {}
        rows = []
        for r in items.join(own.select("key").distinct(), "key", "left_semi").orderBy("item", "key").collect():
            number[r["key"]] = len(rows)
            rows.append((r["item"], r["text"], r["q"], r["a"]))
        held = [(number[r["key"]], r["part"], [w.encode() for w in r["words"]]) for r in own.collect()]
        held.sort(key=lambda x: x[:2])
        frequency = {
            r["w"].encode(): r["count"] for r in per_shard.where(F.col("s") == s).collect()
        }
        yield build_index(rows, [(i, words) for i, _, words in held], frequency, n, mean)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    passage: int = 96,
    stride: int = 32,
    least: float = 0.5,
    overlap: float = 0.5,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, place: all verified pairs."""
    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, item_id string, score double, "
        "question_overlap double, answer_overlap double, place long"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    texts = docs.select("doc_id", raw_text().alias("raw"))
    out = None
    for index in item_indexes(benchmark):

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                leaks = leaks_of(pdf["raw"], index, passage, stride, least, overlap)
                rows = [
                    (doc, item, *hit)
                    for doc, found in zip(pdf["doc_id"], leaks, strict=True)
                    for item, hit in found.items()
                ]
                yield pd.DataFrame(rows, columns=names)

        found = texts.mapInPandas(scan, schema)
        out = found if out is None else out.union(found)
    item = F.col("item_id").cast(dict(benchmark.dtypes)["item_id"]).alias("item_id")
    if out is None:
        out = texts.mapInPandas(lambda batches: iter(()), schema)
        return out.select("doc_id", item, *names[2:])
    best = F.max(F.struct(*[F.col(c) for c in names[2:]])).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", item, "b.*")


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    passage: int = 96,
    stride: int = 32,
    least: float = 0.5,
    overlap: float = 0.5,
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. No shuffle."""

    def leaky(index: ItemIndex) -> Column:
        @F.pandas_udf("boolean")
        def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                leaks = leaks_of(texts, index, passage, stride, least, overlap)
                yield pd.Series([bool(found) for found in leaks], dtype=bool)

        return leaks(raw_text())

    for index in item_indexes(benchmark):
        flag = fresh(docs, "_leak")
        docs = docs.withColumn(flag, leaky(index)).where(~quoted(flag)).drop(flag)
    return docs
