"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint bit is 1 if more than half of the hashes of a text's 3-word shingles have it.
Two texts are linked if their fingerprints differ in ``budget`` bits or fewer. Links are
found in binary tries over the distinct fingerprints: pairs of nodes are walked down
together, bits in which they differ are added up, and a pair is pruned once it exceeds the
budget. Since differing bits touch at most ``budget`` of ``budget + 1`` words of the fingerprint,
some word is equal: the trie is built once per rotation that puts one word on top, and in
that word only equal branches are walked.

Defined results: null text counts as empty; texts without words have fingerprint 0 and
are linked like any others; fewer words than a shingle: the whole sequence is one; component
ids are the smallest document id reached, null ids count only if there is no other; repeated
rows are linked; an empty table gives no rows. Other columns are ignored, and kept by
``one_per_group``, which checks links by exact similarity and adds those beyond the budget (``jaccard``).

Scale: only (doc_id, fingerprint) rows are shuffled. Fingerprints are reduced to distinct
ones before the join, so copies cost one row. Pairs of nodes with more than ``most`` leaves
are split further as a table before any task sees them, so no task holds an unbounded
node. A task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import fresh, numbered_rows, quoted, raw_text
from evalweave.llm.jaccard import similar_links, sketch
from evalweave.operators.components import connected_components
from evalweave.session import materialise

_LEAVES = 50_000
_SMALL = 256
_STEP = 4
_BATCH = 1 << 21


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
    stops = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Adds the fingerprint as a signed BIGINT."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([fingerprint(x) for x in raw], dtype="int64")

    return docs.withColumn(name, prints(raw_text(text)))


class _Forest:
    """Links among n leaves; remembers those that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.root[a] != self.root[b]
        a, b = a[new], b[new]
        if not len(a):
            return
        ends = np.stack([self.root[a], self.root[b]])
        _, first = np.unique(np.sort(ends, axis=0), axis=1, return_index=True)
        for i in first.tolist():
            x, y = self._find(a[i]), self._find(b[i])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.kept.append((int(a[i]), int(b[i])))
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            x = self.root[x]
        return x


def trie_links(
    left: np.ndarray, right: np.ndarray | None, depth: int, apart: int, word: int, budget: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between two nodes of a trie, or inside one.

    ``left`` and ``right`` hold the sorted distinct leaves (uint64) below two nodes at
    ``depth`` that already differ in ``apart`` bits; ``right`` is None for a node with
    itself. Above bit ``word`` only equal branches are walked.
    """
    leaves = left if right is None else np.concatenate([left, right])
    n = len(left)
    forest = _Forest(len(leaves))
    # A node is a range of leaves; same: the pair is a node with itself.
    if right is None:
        front = np.array([[0, n, 0, n, apart, 1]], np.int64)
    else:
        front = np.array([[0, n, n, len(leaves), apart, 0]], np.int64)
    for bit in range(depth, 65):
        size = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        done = (size <= _SMALL) | (bit == 64)
        if bit < word:
            done &= front[:, 5] == 0  # equal branches are walked until the word ends
            lone = (front[:, 5] == 1) & (front[:, 1] - front[:, 0] == 1)
            front, done = front[~lone], done[~lone]
        _compare(leaves, front[done], forest, budget)
        front = front[~done]
        if not len(front) or bit == 64:
            break
        ones = np.concatenate([[0], np.cumsum((leaves >> np.uint64(63 - bit)) & np.uint64(1))])
        ones = ones.astype(np.int64)
        a0, a1, b0, b1, d, same = front.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        children = [np.stack([a0, am, b0, bm, d, same], 1), np.stack([am, a1, bm, b1, d, same], 1)]
        if bit >= word:
            off = np.zeros_like(same)
            children.append(np.stack([a0, am, bm, b1, d + 1, off], 1))
            other = np.stack([am, a1, b0, bm, d + 1, off], 1)
            children.append(other[same == 0])
        front = np.concatenate(children)
        front = front[(front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2]) & (front[:, 4] <= budget)]
    return forest.kept


def _compare(leaves: np.ndarray, pairs: np.ndarray, forest: _Forest, budget: int) -> None:
    """Every leaf of the first node with every leaf of the second, a bounded batch at a time."""
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    total = np.cumsum(size)
    low = 0
    while low < len(pairs):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _BATCH, "right")))
        part, count = pairs[low:high], size[low:high]
        own = np.repeat(np.arange(len(part)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = (part[:, 3] - part[:, 2])[own]
        a, b = part[own, 0] + at // wide, part[own, 2] + at % wide
        near = (np.bitwise_count(leaves[a] ^ leaves[b]) <= budget) & (a != b)
        forest.add(a[near], b[near])
        low = high


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, 64 - depth)


def fingerprint_links(prints: DataFrame, budget: int = 3, most: int = _LEAVES) -> DataFrame:
    """(u, v): links that connect all fingerprints (column fp, distinct) within the budget."""
    words = budget + 1
    width = 64 // words
    turn = [F.struct(F.lit(r).alias("r"), _turned(F.col("fp"), r * width).alias("v")) for r in range(words)]
    members = materialise(prints.select(F.inline(F.array(*turn))), "rotations")
    n = members.count() // words
    depth = min(width, max(1, math.ceil(math.log2(max(2, n / (most / 2))))))
    nodes = members.groupBy("r", _prefix(F.col("v"), depth).alias("a")).count()
    front = nodes.select("r", "a", F.col("a").alias("b"), F.lit(0).alias("d"), F.col("count").alias("n"))
    tasks = None
    while True:
        front = materialise(front, "nodes")
        small = _tasks(members, front.where((F.col("n") <= most) | F.lit(depth == 64)), depth)
        tasks = small if tasks is None else tasks.union(small)
        large = front.where(F.col("n") > most)
        if depth == 64 or large.isEmpty():
            break
        front, depth = _children(members, large, depth, width, budget)
    out = tasks.groupBy("depth", "r", "a", "b").applyInPandas(
        lambda pdf: _task_links(pdf, width, budget), "u long, v long"
    )
    return out


def _turned(value: Column, by: int) -> Column:
    """The bits rotated to the left."""
    if by == 0:
        return value
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _tasks(members: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """The leaves below both nodes of every pair."""
    keyed = members.withColumn("p", _prefix(F.col("v"), depth) if depth < 64 else F.col("v"))
    first = keyed.join(pairs.withColumnRenamed("a", "p"), ["r", "p"]).select(
        "r", F.col("p").alias("a"), "b", "d", "v", F.lit(0).alias("side")
    )
    second = keyed.join(pairs.where("a <> b").withColumnRenamed("b", "p"), ["r", "p"]).select(
        "r", "a", F.col("p").alias("b"), "d", "v", F.lit(1).alias("side")
    )
    return first.union(second).withColumn("depth", F.lit(depth))


def _children(
    members: DataFrame, pairs: DataFrame, depth: int, width: int, budget: int
) -> tuple[DataFrame, int]:
    """The pairs of child nodes, ``_STEP`` bits deeper, that stay within the budget."""
    down = min(depth + _STEP, width if depth < width else 64)
    step = down - depth
    value = _prefix(F.col("v"), down) if down < 64 else F.col("v")
    nodes = materialise(members.groupBy("r", value.alias("x")).count(), "nodes")
    parent = F.shiftrightunsigned("x", step)
    first = nodes.select("r", parent.alias("a"), F.col("x").alias("ca"), F.col("count").alias("na"))
    second = nodes.select("r", parent.alias("b"), F.col("x").alias("cb"), F.col("count").alias("nb"))
    joined = pairs.drop("n").join(first, ["r", "a"]).join(second, ["r", "b"])
    more = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND((1 << step) - 1))
    ordered = (F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))
    allowed = F.col("ca") == F.col("cb") if depth < width else F.col("d") + more <= budget
    out = joined.where(ordered & allowed).select(
        "r",
        F.col("ca").alias("a"),
        F.col("cb").alias("b"),
        (F.col("d") + more).cast("int").alias("d"),
        F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n"),
    )
    return out, down


def _task_links(pdf: pd.DataFrame, width: int, budget: int) -> pd.DataFrame:
    side = pdf["side"].to_numpy()
    value = pdf["v"].to_numpy(np.int64).view(np.uint64)
    left, right = np.unique(value[side == 0]), np.unique(value[side == 1])
    both = left if not len(right) else np.concatenate([left, right])
    depth, apart = int(pdf["depth"].iloc[0]), int(pdf["d"].iloc[0])
    kept = trie_links(left, right if len(right) else None, depth, apart, width, budget)
    ends = both[np.array(kept, np.int64).reshape(-1, 2)]
    by = int(pdf["r"].iloc[0]) * width
    if by:
        ends = (ends >> np.uint64(by)) | (ends << np.uint64(64 - by))
    ends = ends.view(np.int64)
    return pd.DataFrame({"u": ends[:, 0], "v": ends[:, 1]})


def component_of_prints(prints: DataFrame, budget: int = 3, most: int = _LEAVES) -> DataFrame:
    """(fp, component): the component of every distinct fingerprint, named by one of them."""
    links = materialise(fingerprint_links(prints.select("fp"), budget, most), "links")
    linked = connected_components(links)
    return prints.select("fp").join(linked, prints.fp == linked.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(docs: DataFrame, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    held = materialise(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "prints")
    prints = materialise(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    component = component_of_prints(prints, budget)
    named = prints.join(component, "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(named.join(least, "component").select("fp", "component_id"), "components")
    return held.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _close_prints(held: DataFrame, budget: int) -> DataFrame:
    """(u, v), u < v: ids of ``held`` (id, fp) that connect all whose fingerprints link.

    Rows of one fingerprint meet its first row; first rows meet by the links of the tries.
    """
    firsts = materialise(held.groupBy("fp").agg(F.min("id").alias("u")), "distinct")
    same = held.join(firsts, "fp").where("id > u").select("u", F.col("id").alias("v"))
    links = fingerprint_links(firsts.select("fp"), budget).toDF("a", "b")
    a, b = firsts.toDF("a", "x"), firsts.toDF("b", "y")
    met = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return materialise(same.union(met).distinct(), "close")


def one_per_group(
    docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", budget: int = 3
) -> DataFrame:
    """``docs`` with one document per group of near copies: the one with the smallest id, nulls last.

    Near copies have a Jaccard similarity of five-word shingles of ``least`` or more. Texts whose
    fingerprints link are candidates, and each is checked by its whole sets of shingles. At
    0.8 fingerprints differ in more bits than any budget that still tells other texts apart, so
    the copies beyond it are searched by the same check (``jaccard``).
    """
    row = fresh(docs, "_row")
    stored = numbered_rows(docs, row, "simhash")
    texts = stored.select(quoted(row).alias("id"), quoted(key).alias("k"), quoted(text).alias("text"))
    sketched = with_fingerprint(texts.withColumn("s", sketch("text")), "fp")
    held = materialise(sketched.select("id", "k", "fp", "s.*"), "sketches")
    # Nulls come first in a struct's order, so the flag puts them last.
    order = F.struct(F.col("k").isNull(), F.col("k"), F.col("id"))
    # Equal sequences of words are one text.
    distinct = materialise(held.groupBy("digest").agg(F.min(order).alias("first")), "distinct")
    sketches = held.join(distinct.select(F.col("first.id").alias("id")), "id", "left_semi")
    close = _close_prints(materialise(sketches.select("id", "fp"), "prints"), budget)
    links = similar_links(sketches.select("id", "size", "keys"), texts.select("id", "text"), least, close)
    component = connected_components(links)
    named = distinct.join(component, F.col("first.id") == F.col("node"), "left").select(
        "first", F.coalesce("component", "first.id").alias("component")
    )
    chosen = named.groupBy("component").agg(F.min("first").alias("f"))
    return stored.join(chosen.select(F.col("f.id").alias(row)), row, "left_semi").drop(row)
