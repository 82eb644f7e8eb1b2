"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product, in double precision. For the trees every vector x gets one
more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query gets 0 there and the norm
M: then the largest inner product is the smallest distance, and trees of half-spaces apply.

Forest: ``trees`` trees over a bounded sample of the vectors (``sample``, the documented bound). A
node splits at the median along the direction between two of its sampled members. Every vector of the table
is then routed to one leaf of each tree.

Search: one priority queue per query is shared by all trees. A node's priority is the sum of
the squared margins by which the query lies beyond the splits above it. Leaves are popped
nearest first until they hold ``budget`` rows; every row of a popped leaf is scored exactly,
and the ``k`` best are returned.

Recall is set, not hoped for: for up to ``probes`` queries, chosen by hash, the true neighbours
are found by brute force, and the budget is the number of rows at which the queue reaches the leaves of
the share ``recall`` of them. Hard data get a larger budget: vectors without any structure
need a third of all rows and more, as with any index.

Defined results: vectors null, empty, zero, or with null or non-finite components take no part, nor
do rows without an id; a vector that is shorter than others counts as padded with zeros; equal
rows count once; a query never meets rows of its own id; equal scores go to the smaller
id; with fewer than ``k`` candidates all are returned; an empty table gives no rows. Other columns
are ignored.

Scale: equal vectors are one point with its ``k + 1`` smallest ids, which no answer exceeds. Points are
shuffled once per tree, to buckets of bounded size: small leaves share one, and a leaf beyond
the bound is dealt over several. Queries of a bucket come in bounded chunks. A tile (bucket, chunk) returns
``k + 1`` rows per query. The model has at most ``sample / _SAMPLE_LEAF`` leaves per tree; beyond
``leaf_rows`` times as many rows the leaves grow with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import hashed_share
from evalweave.session import materialise

_SAMPLE_LEAF = 16
_BUCKET, _CHUNK, _TILE = 32_768, 16_384, 64


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec, h): the rows that take part; ``h`` is a digest of the vector."""
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    vec = F.col(vector).cast(f"array<{kind}>")
    limit = F.lit(math.inf)
    # A NaN is larger than any number.
    finite = F.forall(vec, lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False)))
    return (
        rows.where(finite & F.exists(vec, lambda x: x != 0))
        .select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
        .where("id is not null")
        .withColumn("h", F.md5(F.array_join("vec", ",").cast("binary")))
    )


def matrix(vectors: pd.Series | list, dim: int) -> np.ndarray:
    """The vectors as rows of doubles, padded with zeros."""
    if not len(vectors):
        return np.zeros((0, dim))
    if all(len(v) == dim for v in vectors):
        return np.stack(list(vectors)).astype(np.float64)
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


@dataclass
class Forest:
    """Complete binary trees: node i has the children 2i + 1 and 2i + 2, leaves come last."""

    planes: np.ndarray  # (trees, inner nodes, dimensions + 1)
    cuts: np.ndarray  # (trees, inner nodes)
    depth: int
    scale: float  # the largest absolute component
    top: float  # the largest norm of a scaled vector
    sizes: np.ndarray | None = None  # rows per (tree, leaf)
    bucket: np.ndarray | None = None  # the first bucket of every (tree, leaf)
    shares: np.ndarray | None = None  # how many buckets it has

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.maximum(self.top**2 - (x * x).sum(axis=1), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        x = self.lifted(x)
        out = np.empty((len(x), len(self.planes)), np.int32)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, planes[node]) > cuts[node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1)
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """(queries, trees, inner nodes): on which side of every split, and how far."""
        norm = np.sqrt((queries / self.scale) ** 2 @ np.ones(queries.shape[1]))
        q = queries / self.scale * (self.top / norm)[:, None]
        trees, inner, width = self.planes.shape
        flat = self.planes[:, :, :-1].reshape(trees * inner, width - 1)
        return (q @ flat.T - self.cuts.reshape(-1)).reshape(len(q), trees, inner)

    def leaves(self, margins: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first, from one queue over all trees."""
        inner = 2**self.depth - 1
        held = margins.tolist()
        queue = [(0.0, t, 0) for t in range(len(held))]
        while queue:
            apart, t, node = heapq.heappop(queue)
            if node >= inner:
                yield t, node - inner
                continue
            m = held[t][node]
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (apart, t, near))
            heapq.heappush(queue, (apart + m * m, t, far))


def grow(sample: np.ndarray, trees: int, depth: int, scale: float, top: float, seed: int = 11) -> Forest:
    """A forest over the sampled vectors."""
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    forest = Forest(
        np.zeros((trees, inner, sample.shape[1] + 1), np.float32), np.zeros((trees, inner)), depth, scale, top
    )
    x = forest.lifted(sample)
    for t in range(trees):
        groups = [np.arange(len(x))]
        for node in range(inner):
            held = groups[node]
            if len(held) > 1:
                a, b = rng.choice(held, 2, replace=False)
                way = x[b] - x[a]
            else:
                way = np.zeros(x.shape[1])
            norm = np.linalg.norm(way)
            if norm == 0:
                way = rng.standard_normal(x.shape[1])
                norm = np.linalg.norm(way)
            plane = forest.planes[t, node] = (way / norm).astype(np.float32)
            at = x[held] @ plane.astype(np.float64)
            cut = forest.cuts[t, node] = np.median(at) if len(held) else 0.0
            groups += [held[at <= cut], held[at > cut]]
    return forest


def _points(rows: DataFrame, k: int) -> DataFrame:
    """(h, vec, ids): equal vectors are one point with its k + 1 smallest ids."""
    order = Window.partitionBy("h").orderBy("id")
    least = rows.dropDuplicates(["id", "h"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return least.groupBy("h").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))


def _packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bucket and the number of buckets of every (tree, leaf)."""
    first, shares = np.zeros(sizes.shape, np.int64), np.ones(sizes.shape, np.int64)
    number = -1
    for t in range(len(sizes)):
        room = 0
        for leaf, n in enumerate(sizes[t].tolist()):
            need = max(1, math.ceil(n / _BUCKET))
            if need > 1 or n > room:
                first[t, leaf], shares[t, leaf] = number + 1, need
                number += need
                room = _BUCKET - n if need == 1 else 0
            else:
                first[t, leaf] = number
                room -= n
    return first, shares


def _best(points: np.ndarray, ids: list, q: np.ndarray, among: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k + 1 best (id, score) of the points ``among``; ties to the smaller id."""
    score = (points[among] * q).sum(axis=1)  # summed alike wherever a point stands
    order = np.lexsort(([ids[i][0] for i in among], -score))[: k + 1]
    held = [(float(score[o]), int(i)) for o in order for i in ids[among[o]]]
    held.sort(key=lambda x: (-x[0], x[1]))
    return [(i, s) for s, i in held[: k + 1]]


def _near_top(scores: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """Where a row may hold one of its k + 1 best, whatever the rounding of the product."""
    if len(scores) <= k + 1:
        return np.flatnonzero(scores > -np.inf)
    least = np.partition(scores, -(k + 1))[-(k + 1)]
    with np.errstate(invalid="ignore"):
        return np.flatnonzero((scores >= least - reach) & (scores > -np.inf))


def _answers(points: pd.DataFrame, asks: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """One tile: the k + 1 best of every query among the leaves that it popped."""
    out: list[tuple] = []
    if len(points) and len(asks):
        x = matrix(points["vec"], dim)
        codes, place = np.unique(points["leaf"].to_numpy(), return_inverse=True)
        number = {c: i for i, c in enumerate(codes.tolist())}
        ids = points["ids"].tolist()
        norms = np.sqrt((x * x).sum(axis=1))
        for low in range(0, len(asks), _TILE):
            part = asks.iloc[low : low + _TILE]
            q = matrix(part["vec"], dim)
            open_ = np.zeros((len(q), len(codes)), bool)
            for row, leaves in zip(open_, part["leaves"], strict=True):
                row[[number[c] for c in leaves if c in number]] = True
            scores = np.where(open_[:, place], q @ x.T, -np.inf)
            slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * norms.max()
            for i, h in enumerate(part["h"]):
                near = _near_top(scores[i], slack[i], k)
                out += [(h, v, s) for v, s in _best(x, ids, q[i], near, k)]
    return pd.DataFrame(out, columns=["h", "vec_id", "score"])


def _true_neighbours(points: DataFrame, asked: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """(n, leaves): the k + 1 best points of the n-th asked query, by brute force."""
    q = matrix(asked["vec"], dim)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = q @ matrix(pdf["vec"], dim).T
            least = np.array([x[0] for x in pdf["ids"]])
            for n, row in enumerate(scores):
                best = np.lexsort((least, -row))[: k + 1]
                yield pd.DataFrame(
                    {"n": n, "score": row[best], "least": least[best], "leaves": pdf["leaves"].iloc[best].tolist()}
                )

    found = points.mapInPandas(scan, "n int, score double, least long, leaves array<int>")
    order = Window.partitionBy("n").orderBy(F.desc("score"), "least")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return best.select("n", "leaves").toPandas()


def _budget(forest: Forest, asked: np.ndarray, true: pd.DataFrame, recall: float) -> int:
    """The rows to pop so that the queue reaches the share ``recall`` of the true neighbours."""
    costs: list[int] = []
    margins = forest.margins(asked)
    for n, held in true.groupby("n")["leaves"]:
        open_ = [set(enumerate(x.tolist())) for x in map(np.asarray, held)]
        seen = 0
        for leaf in forest.leaves(margins[n]):
            seen += int(forest.sizes[leaf])
            reached = [x for x in open_ if leaf in x]
            costs += [seen] * len(reached)
            open_ = [x for x in open_ if leaf not in x]
            if not open_:
                break
    costs.sort()
    return costs[max(0, math.ceil(recall * len(costs)) - 1)] if costs else 0


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 128,
    sample: int = 131_072,
    probes: int = 64,
    recall: float = 0.95,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query.

    Both tables come from ``usable``.
    """
    spark = rows.sparkSession
    points = materialise(_points(rows, k), "points")
    n, dim, scale = points.agg(
        F.count(F.lit(1)),
        F.max(F.size("vec")),
        F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).cast("double"),
    ).first()
    asks = materialise(
        queries.dropDuplicates(["id", "h"]).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "asks"
    )
    schema = "query_id long, rank int, vec_id long, score double"
    n_asks = asks.count()
    if not n or not n_asks:
        return spark.createDataFrame([], schema)
    dim = max(dim, asks.agg(F.max(F.size("vec"))).first()[0])
    scaled = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.lit(scale)) * (x / F.lit(scale)))
    top = math.sqrt(points.agg(F.max(scaled)).first()[0]) * (1 + 1e-12)
    chosen = points.where(hashed_share(F.col("h"), F.lit(min(1.0, sample / n)))).select("h", "vec").toPandas()
    held = matrix(chosen.sort_values("h")["vec"], dim)
    depth = max(0, min(math.ceil(math.log2(n / leaf_rows)), int(math.log2(max(1, len(held) / _SAMPLE_LEAF)))))
    forest = grow(held, trees, depth, scale, top)
    routes = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("array<int>")
    def routed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            yield pd.Series(list(routes.value.route(matrix(vec, dim))))

    points = materialise(points.withColumn("leaves", routed("vec")), "routed")
    leaf = points.select("h", F.posexplode("leaves").alias("tree", "leaf"))
    # The model's leaves, a bounded number.
    forest.sizes = np.zeros((trees, 2**depth), np.int64)
    for t, x, size in leaf.groupBy("tree", "leaf").count().collect():
        forest.sizes[t, x] = size
    forest.bucket, forest.shares = _packed(forest.sizes)

    asked = asks.where(hashed_share(F.col("h"), F.lit(min(1.0, probes / n_asks)))).select("h", "vec").toPandas()
    if not len(asked):
        asked = asks.orderBy("h").limit(1).select("h", "vec").toPandas()
    budget = _budget(forest, matrix(asked["vec"], dim), _true_neighbours(points, asked, dim, k), recall)
    model = spark.sparkContext.broadcast(forest)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = model.value
        for pdf in batches:
            for low in range(0, len(pdf), _TILE):
                part = pdf.iloc[low : low + _TILE]
                out = []
                for h, vec, m in zip(
                    part["h"], part["vec"], forest.margins(matrix(part["vec"], dim)), strict=True
                ):
                    popped: dict[int, list[int]] = {}
                    seen = 0
                    for t, x in forest.leaves(m):
                        for share in range(forest.shares[t, x]):
                            popped.setdefault(int(forest.bucket[t, x]) + share, []).append((t << 26) + x)
                        seen += int(forest.sizes[t, x])
                        if seen >= budget:
                            break
                    out += [(h, vec, bucket, leaves) for bucket, leaves in popped.items()]
                yield pd.DataFrame(out, columns=["h", "vec", "bucket", "leaves"])

    kind = dict(asks.dtypes)["vec"]
    wanted = materialise(
        asks.select("h", "vec").mapInPandas(search, f"h string, vec {kind}, bucket long, leaves array<int>"), "popped"
    )
    chunks = wanted.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / _CHUNK).cast("int").alias("chunks"))

    @F.pandas_udf("long")
    def bucket_of(h: pd.Series, tree: pd.Series, leaf: pd.Series) -> pd.Series:
        forest = model.value
        t, x = tree.to_numpy(), leaf.to_numpy()
        salt = np.array([int(v[:8], 16) for v in h], np.int64)
        return pd.Series(forest.bucket[t, x] + salt % forest.shares[t, x])

    dealt = (
        points.select("h", "vec", "ids", F.posexplode("leaves").alias("tree", "x"))
        .select("vec", "ids", bucket_of("h", "tree", "x").alias("bucket"), (F.shiftleft("tree", 26) + F.col("x")).alias("leaf"))
        .join(chunks, "bucket")
        .select("vec", "ids", "bucket", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    )
    asking = wanted.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
    tiles = (
        dealt.groupBy("bucket", "chunk")
        .cogroup(asking.select("h", "vec", "leaves", "bucket", "chunk").groupBy("bucket", "chunk"))
        .applyInPandas(lambda a, b: _answers(a, b, dim, k), "h string, vec_id long, score double")
    )
    order = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    best = materialise(
        # A point may have been found in several trees; its score is the same.
        tiles.groupBy("h", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)
        .groupBy("h")
        .agg(F.collect_list(F.struct("vec_id", "score")).alias("found")),
        "found",
    )
    # A vector that very many queries share meets them in several tasks.
    copies = asks.select("h", F.ceil(F.col("n") / _CHUNK).cast("int").alias("copies"))
    spread = best.join(copies, "h").select(
        "h", "copies", "found", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    who = queries.select("id", "h").dropDuplicates(["id", "h"]).join(copies, "h").select(
        F.col("id").alias("query_id"), "h", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy")
    )
    other = F.slice(F.filter(_ordered("found"), lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return who.join(spread.drop("copies"), ["h", "copy"]).select("query_id", F.posexplode(other).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )


def _ordered(found: str) -> Column:
    """Best first, ties to the smaller id."""
    keyed = F.transform(found, lambda x: F.struct((-x["score"]).alias("a"), x["vec_id"].alias("vec_id"), x["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")))


def nearest_neighbours(rows: DataFrame, k: int = 20, every: int = 20, **options) -> DataFrame:
    """The nearest of every row whose id is divisible by ``every``, among all rows but its own."""
    held = usable(rows)
    return nearest(held, held.where(F.col("id") % every == 0), k, **options)
