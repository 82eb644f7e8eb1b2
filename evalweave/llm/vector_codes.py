"""Product codes of vectors: ball k-means on integers, the same result on any cluster.

Components become floor(1024 * x). Vectors are cut into 4 equal consecutive parts, and each part position
has a codebook of up to 256 entries. It starts as that part of the 256 smallest ids;
4 rounds assign every part to its nearest entry (squared Euclidean distance, ties to the
lower index) and replace each used entry by the floored mean of its parts; then parts are
assigned once more.

Ball k-means: the parts assigned to an entry form a ball around it. An entry j can take a part at
distance d from its entry i only if dist(i, j) <= 2 d, ties included. So
- the ball's radius bounds its neighbour entries (dist <= 2 radius), all others are never read;
- a part in the stable core, below half the distance to the nearest other entry, skips work;
- neighbours sorted by distance part the rest of the ball into annular rings, and a part is compared
  exactly with the entries up to its own ring.
Balls are formed among the parts of one Arrow batch, whose radii are at most the whole ball's,
so the filters need no pass of their own. All of it is exact integer arithmetic: doubles hold
the products while they stay below 2^53, beyond that Python integers do.

Defined results: rows whose vector is null or empty or holds null or non-finite components are
dropped; the dimension is the longest vector's, rounded up to a multiple of 4, and shorter vectors
count as padded with zeros; null ids come after all others; repeated rows are coded each; fewer than 256 rows
give smaller codebooks; equal labels include null with null; an error beyond 64 bits is null; an empty
table gives no rows. Other columns are ignored.

Scale: the model is 4 x 256 entries whatever the size of the table. A round is a scan that
writes the codes beside the components (no shuffle), and one that adds up (part, entry) sums
in the task; only those, at most 1,024 rows per task, are shuffled. The driver gets the 1,024 sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise

PARTS, ENTRIES, ROUNDS, GRID = 4, 256, 4, 1024
_WHOLE = 1 << 42
_RINGS = (2, 4, 8, 16, 32, 64, 128, 256)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): the rows that are coded."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    named = F.col(label) if label in rows.columns else F.lit(None).cast("int")
    return rows.where(finite & (F.size(vec) > 0)).select(F.col(key).alias("vec_id"), named.alias("label"), vec.alias("v"))


def grid(vectors: pd.Series | list, dim: int) -> np.ndarray:
    """floor(1024 * x) as doubles, or as Python integers where doubles would not be exact."""
    x = np.zeros((len(vectors), dim))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    # A product with a power of two is exact unless it overflows.
    if not len(x) or np.abs(x).max() < _WHOLE / GRID:
        return np.floor(x * GRID)
    return np.array([[math.floor(v) * GRID + math.floor((v - math.floor(v)) * GRID) for v in row] for row in x.tolist()], object)


def _alike(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in one exact arithmetic: four squared distances must be whole doubles."""
    most = math.isqrt((1 << 53) // (16 * max(1, x.shape[1])))
    if any(a.dtype == object or (a.size and np.abs(a).max() >= most) for a in (x, entries)):
        whole = np.frompyfunc(int, 1, 1)
        return whole(x).astype(object), whole(entries).astype(object)
    return x, entries


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x.dot(y.T)


def ball_assign(x: np.ndarray, entries: np.ndarray, before: np.ndarray, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts ``x``, which were assigned to ``before``.

    ``work`` counts what was compared, for tests and figures.
    """
    x, entries = _alike(x, entries)
    apart = squares(entries, entries)
    codes = before.astype(np.int64)
    own = ((x - entries[codes]) ** 2).sum(axis=1)
    best = own.copy()
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[starts[i] : starts[i + 1]]
        if not len(ball):
            continue
        radius = own[ball].max()
        near = np.flatnonzero(apart[i] <= 4 * radius)
        near = near[np.argsort(apart[i][near], kind="stable")]
        # The ring of a part: how many entries are within twice its distance, its own included.
        reach = np.searchsorted(apart[i][near], 4 * own[ball], side="right")
        least = 0
        for most in _RINGS:
            ring = ball[(reach > max(least, 1)) & (reach <= most)]
            if len(ring):
                rivals = np.sort(near[:most])  # in order of index, so that the first minimum is the lowest
                held = squares(x[ring], entries[rivals])
                at = np.array(held.argmin(axis=1), np.int64)
                codes[ring], best[ring] = rivals[at], held[np.arange(len(ring)), at]
                if work is not None:
                    work["compared"] = work.get("compared", 0) + held.size
            least = most
        if work is not None:
            work["stable"] = work.get("stable", 0) + int((reach <= 1).sum())
    return codes, best


def _whole(x: np.ndarray) -> list[list[int]]:
    return [[int(v) for v in row] for row in x]


def _entries(book: list[list[int]]) -> np.ndarray:
    if max((abs(v) for row in book for v in row), default=0) < _WHOLE:
        return np.array(book, np.float64)
    return np.array(book, object)


def _assigned(held: DataFrame, books: list[list[list[int]]], dim: int) -> DataFrame:
    """``held`` with new codes and errors."""
    width = dim // PARTS

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = [_entries(b) for b in books]
        for pdf in batches:
            x = grid(pdf["v"], dim)
            before = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(-1, PARTS)
            codes = np.empty_like(before)
            error = np.zeros(len(pdf), object)
            for p in range(PARTS):
                got, best = ball_assign(x[:, p * width : (p + 1) * width], entries[p], before[:, p])
                codes[:, p] = got
                error = error + np.array([int(v) for v in best], object)
            pdf["code"] = [c.tobytes() for c in codes]
            pdf["error"] = pd.array([v if v < 1 << 63 else pd.NA for v in error], "Int64")
            yield pdf

    return materialise(held.mapInPandas(assign, held.schema), "codes")


def _sums(held: DataFrame, dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, component sums); at most 1,024 rows come to the driver."""
    width = dim // PARTS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}
        for pdf in batches:
            x = grid(pdf["v"], dim)
            x = x if x.dtype == object else x.astype(np.int64)
            codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                part = np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                counts = np.diff(np.append(first, len(order)))
                for c, row, n in zip(used.tolist(), part, counts.tolist(), strict=True):
                    held = total.setdefault((p, c), [0, [0] * width])
                    held[0] += n
                    held[1] = [a + int(b) for a, b in zip(held[1], row, strict=True)]
        rows = [(p, c, n, [str(s) for s in sums]) for (p, c), (n, sums) in total.items()]
        yield pd.DataFrame(rows, columns=["p", "c", "n", "s"])

    parts = held.select("v", "code").mapInPandas(add, "p int, c int, n long, s array<string>")
    each = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    return {
        (r[0], r[1]): (r[2], [int(v) for v in r[3:]])
        for r in parts.groupBy("p", "c").agg(F.sum("n").alias("n"), *each).collect()
    }


def learn_codes(
    vectors: DataFrame, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, v, code, error) and the codebooks; ``vectors`` comes from ``usable``."""
    zero = F.unhex(F.lit("00" * PARTS))
    held = materialise(vectors.withColumn("code", zero).withColumn("error", F.lit(0).cast("long")), "vectors")
    longest = held.agg(F.max(F.size("v"))).first()[0] or 0
    dim = PARTS * math.ceil(longest / PARTS)
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    if not first:
        return held, [[] for _ in range(PARTS)]
    start = _whole(grid([r["v"] for r in first], dim))
    width = dim // PARTS
    books = [[row[p * width : (p + 1) * width] for row in start] for p in range(PARTS)]
    for _ in range(rounds):
        held = _assigned(held, books, dim)
        for (p, c), (n, sums) in _sums(held, dim).items():
            books[p][c] = [s // n for s in sums]
    return _assigned(held, books, dim), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()


def vector_codes(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row."""
    held, books = learn_codes(usable(rows), rounds)
    coded = held.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    # One row per label, far fewer than rows where labels are shared; a hot label is summed before the shuffle.
    total = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    kept = total.withColumnRenamed("label", "_label")
    return coded.join(kept, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def oracle(rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry, one table per round."""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor({GRID} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM kept, range({PARTS}) t(p)
), book0 AS (SELECT p, r - 1 AS c, x AS e FROM parts WHERE r <= {ENTRIES})"""]
    for i in range(rounds + 1):
        steps.append(f"""dist{i} AS (
  SELECT r, p, c, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts JOIN book{i} USING (p)
), near{i} AS (
  SELECT r, p, arg_min(c, d * {ENTRIES} + c) AS c, min(d) AS d FROM dist{i} GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
  SELECT p, c, list(m ORDER BY j) AS e FROM (
    SELECT p, c, j, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m FROM (
      SELECT p, c, unnest(range(len(x))) AS j, unnest(x) AS y FROM near{i} JOIN parts USING (r, p)
    ) GROUP BY p, c, j) GROUP BY p, c
), book{i + 1} AS (
  SELECT p, c, coalesce(mean{i}.e, book{i}.e) AS e FROM book{i} LEFT JOIN mean{i} USING (p, c)
)""")
    steps.append(f"""sha AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, c)) AS s FROM book{rounds}
), coded AS (
  SELECT r, string_agg(lower(printf('%02x', c::BIGINT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM coded JOIN kept USING (r), sha""")
    return ", ".join(steps[:-1]) + ", " + steps[-1]
