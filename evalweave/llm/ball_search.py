"""Ranked lexical search: exact inner products over a ball tree of sparse documents.

A document's vector has, per term of the items, floor(1e9 tf / (1000 tf + 20 m)); an item's vector has the
weights w of its terms. The score is their inner product. Weights are multiplied into the
documents' components, which leaves the products as they are, so an item is a set of terms.

Tree: blocks of documents are split at the median along the direction between two distant documents,
down to leaves of ``leaf`` documents. A node keeps its centroid and radii: the terms are dealt into ``_BALLS``
groups, and per group there is the radius around the centroid. By Cauchy's inequality in every
group no document below scores more than

    sum over the item's terms of the centroid + sum over groups of sqrt(terms of the item) * radius

which is rounded upwards by more than its arithmetic can be off (``_UP``). Nodes wait in one
queue per block, highest bound over the worst kept score first, and carry the items for which they are still open.
A node is left out for an item once its bound is below the item's ``k``-th score so far. At
leaves scores are exact 64-bit integers. The k-th scores start from a bounded sample of the documents
(``seed_rows``), scored first; they only prune, so the result is that of all documents.

Defined results: null texts have no terms; documents without terms don't count in N; items
without terms, or whose terms stand in no document, have no rows; equal items (id and text) are one, other
items of one id are ranked each; repeated documents are ranked each; null ids come after
all others among equal scores; empty tables give no rows. Other columns are ignored.

Scale: items are the query set and come in shards of ``shard_bytes`` of text, one scan of the documents
each. Stored are the documents' counts of item terms, not texts. Blocks are formed inside the
tasks without a shuffle; a task returns at most ``k`` rows per item, and only those that reach the
sample's k-th score are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import LETTERS, raw_text
from evalweave.session import materialise

K, _BALLS, _UP, _PIECE = 50, 1024, 1e-9, 1 << 20


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text; a long one comes in pieces cut between terms."""
    held = raw.translate(LETTERS)
    at = 0
    while at < len(held):
        end = held.find(b" ", at + _PIECE) if at + _PIECE < len(held) else -1
        end = len(held) if end < 0 else end
        yield held[at:end].split()
        at = end


def known_terms(raw: bytes, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(terms with repeats, numbers of the known ones, their occurrences)."""
    n, held = 0, [np.empty(0, np.int64)]
    get = number.get
    for words in pieces(raw):
        n += len(words)
        held.append(np.array([i for i in map(get, words) if i is not None], np.int64))
    return n, *np.unique(np.concatenate(held), return_counts=True)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Items:
    """The items of a shard: for each the numbers of its terms, one after the other."""

    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int
    least: np.ndarray  # scores below this are not among the k best

    def __len__(self) -> int:
        return len(self.starts) - 1

    def components(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The weighted components of documents, ``length`` terms long, as 64-bit integers."""
        if len(length) and 50 * int(length.max()) * self.n_docs >= 1 << 63:
            m = np.array([50 + 50 * int(n) * self.n_docs // self.n_terms for n in length], np.int64)
        else:
            m = 50 + 50 * length * self.n_docs // self.n_terms
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Block:
    """Some documents as sparse rows, over the terms that they hold."""

    def __init__(self, pdf: pd.DataFrame, items: Items):
        sizes = pdf["term"].map(len).to_numpy() // 4
        term = np.frombuffer(b"".join(pdf["term"]), np.uint32).astype(np.int64)
        tf = np.frombuffer(b"".join(pdf["tf"]), np.uint32).astype(np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(sizes)])
        self.row = np.repeat(np.arange(len(pdf)), sizes)
        self.value = items.components(term, tf, pdf["n"].to_numpy(np.int64)[self.row])
        self.held, self.col = np.unique(term, return_inverse=True)
        # (null or not, id): nulls sort after all others.
        self.ids = list(zip(pdf["none"].tolist(), pdf["doc_id"].tolist(), strict=True))
        # The items over the block's own terms; items without any are left out.
        number = np.full(len(items.weights), -1)
        number[self.held] = np.arange(len(self.held))
        own = number[items.terms]
        item = np.repeat(np.arange(len(items)), np.diff(items.starts))[own >= 0]
        self.item_cols = own[own >= 0]
        self.items, place, sizes = np.unique(item, return_inverse=True, return_counts=True)
        self.item_starts = np.concatenate([[0], np.cumsum(sizes)])
        # The groups of terms that an item meets, and the root of the number of its terms there.
        pair, count = np.unique(place * _BALLS + self.item_cols % _BALLS, return_counts=True)
        self.item_balls, self.item_roots = pair % _BALLS, np.sqrt(count)
        self.ball_starts = np.searchsorted(pair, np.arange(len(self.items) + 1) * _BALLS)


def ranges_of(starts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the active ranges one after the other, and where each begins."""
    low, size = starts[active], starts[active + 1] - starts[active]
    first = np.cumsum(size) - size
    return np.repeat(low - first, size) + np.arange(size.sum()), first


class BallTree:
    """Nodes are ranges of ``order``; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, block: Block, leaf: int):
        n, width = len(block.ids), len(block.held)
        self.block = block
        self.depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
        self.group = np.arange(width) % _BALLS
        value = block.value.astype(np.float64)
        norm = np.bincount(block.row, value**2, n)
        self.centre: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        self.ranges: list[tuple[int, int]] = []
        self.order = np.arange(n)
        bounds = np.array([0, n])
        for level in range(self.depth + 1):
            nodes = len(bounds) - 1
            node = np.empty(n, np.int64)
            node[self.order] = np.repeat(np.arange(nodes), np.diff(bounds))
            of = node[block.row]
            size = np.maximum(np.diff(bounds), 1)
            centre = np.bincount(of * width + block.col, value, nodes * width).reshape(nodes, width) / size[:, None]
            self._balls(centre, node, of, value, bounds)
            self.ranges += list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            if level == self.depth:
                break
            way = self._ways(centre, node, of, value, norm, bounds)
            at = np.bincount(block.row, value * way[of, block.col], n)
            self.order = self.order[np.lexsort((at[self.order], node[self.order]))]
            middle = (bounds[:-1] + bounds[1:]) // 2
            bounds = np.sort(np.concatenate([bounds, middle]))

    def _balls(self, centre, node, of, value, bounds) -> None:
        block = self.block
        n, groups = len(node), min(_BALLS, max(1, centre.shape[1]))
        squares = np.zeros((len(centre), groups))
        for g in range(groups):
            squares[:, g] = (centre[:, g::_BALLS] ** 2).sum(axis=1)
        own = centre[of, block.col]
        cell = block.row * groups + self.group[block.col]
        less = np.bincount(cell, (value - own) ** 2 - own**2, n * groups).reshape(n, groups)
        largest = np.bincount(cell, value**2, n * groups).reshape(n, groups)
        apart = np.maximum(less + squares[node], 0) + _UP * (squares[node] + largest)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            self.centre.append(centre[i])
            held = apart[self.order[a:b]]
            self.radius.append(np.sqrt(held.max(axis=0)) if len(held) else np.zeros(groups))

    def _ways(self, centre, node, of, value, norm, bounds) -> np.ndarray:
        """Per node the direction from the document farthest from the centroid to the one farthest from it."""
        block, n = self.block, len(node)
        ends = []
        other = centre
        for _ in range(2):
            dot = np.bincount(block.row, value * other[of, block.col], n)
            apart = norm - 2 * dot + (other**2).sum(axis=1)[node]
            far = np.zeros_like(centre)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if b > a:
                    d = self.order[a + int(apart[self.order[a:b]].argmax())]
                    s = slice(block.ptr[d], block.ptr[d + 1])
                    far[i, block.col[s]] = value[s]
            ends.append(far)
            other = far
        return ends[1] - ends[0]

    def bounds(self, node: int, active: np.ndarray) -> np.ndarray:
        """What no document below the node exceeds, for each of the block's items ``active``."""
        block = self.block
        at, first = ranges_of(block.item_starts, active)
        inside = np.add.reduceat(self.centre[node][block.item_cols[at]], first)
        at, first = ranges_of(block.ball_starts, active)
        around = np.add.reduceat(self.radius[node][block.item_balls[at]] * block.item_roots[at], first)
        return (inside + around) * (1 + _UP) + 1

    def scores(self, node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) below a leaf."""
        block = self.block
        a, b = self.ranges[node]
        docs = self.order[a:b]
        dense = np.zeros((len(docs), len(block.held)), np.int64)
        for i, d in enumerate(docs):
            s = slice(block.ptr[d], block.ptr[d + 1])
            dense[i, block.col[s]] = block.value[s]
        at, first = ranges_of(block.item_starts, active)
        return docs, np.add.reduceat(dense[:, block.item_cols[at]], first, axis=1)


class Kept:
    """The k best of every item so far: score descending, then id, nulls last."""

    def __init__(self, items: Items, k: int):
        self.k, self.least = k, items.least.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(len(items))]

    def add(self, item: int, found: list[tuple[int, tuple]]) -> None:
        rows = self.rows[item]
        rows += [(-score, doc) for score, doc in found]
        if len(rows) >= 4 * self.k:
            self.trim(item)
        elif len(rows) >= self.k:
            self.least[item] = max(self.least[item], -sorted(r[0] for r in rows)[self.k - 1])

    def trim(self, item: int) -> None:
        rows = self.rows[item]
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k:
            self.least[item] = max(self.least[item], -rows[-1][0])


def search_block(tree: BallTree, kept: Kept, work: Counter | None = None) -> None:
    """Best first through the tree; ``work`` counts scored documents for tests and figures."""
    block = tree.block
    if not len(block.items):
        return
    queue: list[tuple] = []

    def push(node: int, active: np.ndarray, above: np.ndarray) -> None:
        if tree.ranges[node][0] == tree.ranges[node][1]:
            return
        bound = np.minimum(tree.bounds(node, active), above)
        ahead = bound / kept.least[block.items[active]]
        still = ahead >= 1
        if still.any():
            heapq.heappush(queue, (-float(ahead.max()), node, active[still], bound[still]))

    every = np.arange(len(block.items))
    push(0, every, np.full(len(every), np.inf))
    while queue:
        _, node, active, bound = heapq.heappop(queue)
        still = bound >= kept.least[block.items[active]]
        active, bound = active[still], bound[still]
        if not len(active):
            continue
        if 2 * node + 1 < len(tree.ranges):
            push(2 * node + 1, active, bound)
            push(2 * node + 2, active, bound)
            continue
        docs, scores = tree.scores(node, active)
        if work is not None:
            work["scored"] += scores.size
        least = kept.least[block.items[active]]
        reach = scores >= least
        for j in np.flatnonzero(reach.any(axis=0)):
            rows = np.flatnonzero(reach[:, j])
            kept.add(int(block.items[active[j]]), [(int(scores[i, j]), block.ids[docs[i]]) for i in rows])


def _blocks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        pdf = pdf[pdf["term"].map(len) > 0]
        for at in range(0, len(pdf), rows):
            part = pdf.iloc[at : at + rows]
            if n + len(part) > rows:
                yield pd.concat(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield pd.concat(held)


def _shard(docs: DataFrame, texts: list[bytes], k: int, leaf: int, seed_rows: int) -> DataFrame | None:
    """(item, doc_id, score) with the number of the item among ``texts``."""
    spark = docs.sparkSession
    held = [sorted({t for words in pieces(x) for t in words}) for x in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in held for t in x}))}
    known = spark.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for pdf in batches:
            rows = []
            for raw in pdf["raw"]:
                n, term, tf = known_terms(raw, number)
                rows.append((n, term.astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes()))
            out = pd.DataFrame(rows, columns=["n", "term", "tf"])
            out.insert(0, "none", pdf["none"].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    # A null id goes to Python as a value and a flag, since whole numbers with nulls would become floats.
    named = docs.select(
        F.coalesce("doc_id", F.lit("0").cast(kind)).alias("doc_id"),
        F.col("doc_id").isNull().alias("none"),
        raw_text().alias("raw"),
    )
    vectors = materialise(
        named.mapInPandas(count, f"doc_id {kind}, none boolean, n long, term binary, tf binary"),
        "vectors",
    )
    n_docs, n_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(known.value), np.int64)
        for pdf in batches:
            df += np.bincount(np.frombuffer(b"".join(pdf["term"]), np.uint32), minlength=len(df))
        yield pd.DataFrame({"t": np.flatnonzero(df), "df": df[df > 0]})

    counted = vectors.select("term").mapInPandas(frequencies, "t long, df long").groupBy("t").agg(F.sum("df"))
    df = dict(counted.collect())
    weights = np.array([term_weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    items = Items(
        np.array([vocabulary[t] for x in held for t in x], np.int64),
        np.concatenate([[0], np.cumsum([len(x) for x in held])]),
        weights, n_docs, n_terms, np.ones(len(held), np.int64),
    )
    most = int(min(4096, max(16 * leaf, leaf * (1 << 22) / len(vocabulary))))

    def searched(vectors: DataFrame, items: Items) -> DataFrame:
        model = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = Kept(model.value, k)
            for pdf in _blocks(batches, most):
                search_block(BallTree(Block(pdf, model.value), leaf), kept)
            for item in range(len(kept.rows)):
                kept.trim(item)
                if kept.rows[item]:
                    rows = [(item, doc, none, -score) for score, (none, doc) in kept.rows[item]]
                    yield pd.DataFrame(rows, columns=["item", "doc_id", "none", "score"])

        found = vectors.mapInPandas(search, f"item int, doc_id {kind}, none boolean, score long")
        return found.select("item", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "score")

    by_score = Window.partitionBy("item").orderBy(F.desc("score"))
    sample = searched(vectors.where(F.rand(12) < F.lit(min(1.0, seed_rows / n_docs))), items)
    floor = sample.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("item", "score")
    for item, score in floor.collect():
        items.least[item] = max(1, score)
    return materialise(searched(vectors, items), "found")


def ranked_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = K,
    leaf: int = 8,
    seed_rows: int = 16_384,
    shard_bytes: int = 1 << 22,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, scores above 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select("item_id", text.alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    out = docs.sparkSession.createDataFrame([], f"item long, item_id {kinds[1]}, doc_id {kinds[0]}, score long")
    for s in range(shards):
        # One shard of the query set is on the driver.
        part = items.where(shard == s).orderBy("item_id", "text").collect()
        found = _shard(docs, [r["text"].encode() for r in part], k, leaf, seed_rows) if part else None
        if found is not None:
            names = docs.sparkSession.createDataFrame(
                [(i, s << 32 | i, r["item_id"]) for i, r in enumerate(part)],
                f"item int, number long, item_id {kinds[1]}",
            )
            out = out.union(found.join(F.broadcast(names), "item").select("number", "item_id", "doc_id", "score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )


def oracle(k: int = K) -> str:
    """The same over all pairs of an item and a document that share a term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gaps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def words(text: str) -> str:
        plain = f"regexp_replace(translate(coalesce({text}, ''), '{upper}', '{lower}'), '{gaps}', ' ', 'g')"
        return f"list_filter(string_split({plain}, ' '), lambda x: x <> '')"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
corpus AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
items AS (
  SELECT row_number() OVER () AS i, item_id, {words('text')} AS w
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), wanted AS (SELECT DISTINCT i, t FROM (SELECT i, unnest(w) AS t FROM items)),
held AS (
  SELECT r, t, count(*)::BIGINT AS tf, any_value(n) AS n
  FROM (SELECT r, len(w)::BIGINT AS n, unnest(w) AS t FROM docs) SEMI JOIN wanted USING (t) GROUP BY r, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * corpus.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, corpus GROUP BY t, corpus.n
), scores AS (
  SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * held.n * corpus.n) // corpus.l))))::BIGINT AS score
  FROM wanted JOIN held USING (t) JOIN weights USING (t), corpus GROUP BY i, r
), ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scores JOIN items USING (i) JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
