"""Clustered bootstrap intervals and paired sign tests.

A replicate draws clusters with replacement and pools their members, so its mean is the sum
of cluster sums over the sum of cluster sizes. Only (sum, size) per cluster is needed; no
member row is repeated. Sums are held in units of 1e-9 as BIGINT, which makes a replicate
independent of summation order and hence equal after a retry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.draws import MASK, MIX_A, MIX_B, chain, group_seed, hash60, joined_keys
from evalweave.functions.text import round4
from evalweave.operators.ordering import with_constants
from evalweave.session import materialise, wide_partitions

REPLICATES = 2000
SEED = 42
MIN_CLUSTERS = 5
_SCALE = 1_000_000_000
CHUNK = 4096
TILE = 16
TILE_ITEMS = 4096
_RANGE = 1 << 20
# Draws made at a time: arrays of this length stay in the cache.
_BLOCK = 1 << 15


def cluster_sums(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cluster) -> s, n from rows (by, cluster, score)."""
    fixed = F.round(F.col("score") * _SCALE).cast("long")
    return scores.groupBy(*by, "cluster").agg(
        F.sum(fixed).alias("s"), F.count(F.lit(1)).alias("n")
    )


def with_cluster_index(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dense 0-based index of each cluster in its group, in hash order.

    Hash order splits any group into 4096 near-equal buckets, so no window holds a whole
    group: positions are counted inside buckets and shifted by the bucket offsets.
    """
    by = list(by)
    hashed = sums.withColumn("_h", hash60(F.col("cluster"))).withColumn(
        "_bucket", F.shiftright("_h", 48)
    )
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", "cluster")
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn("idx", F.col("_off") + F.col("_rn") - 1)
        .drop("_h", "_bucket", "_rn", "_off")
    )


def replicate_means(
    indexed: DataFrame,
    groups: DataFrame,
    replicates: int = REPLICATES,
    chunk: int = CHUNK,
) -> DataFrame:
    """(g, b) -> m for every replicate of every group.

    ``groups`` holds g, seed and k; ``indexed`` holds g, idx, s, n. Clusters are cut into
    chunks of ``chunk`` consecutive indexes. A replicate first draws the chunk of each of its
    k positions and keeps only the counts; the clusters themselves are drawn beside their
    chunk. So about k / ``chunk`` rows per replicate are shuffled, no task holds more than
    one chunk of clusters, and one rule serves every size. A group of a single chunk needs
    no first step.
    """
    parts = wide_partitions(groups.sparkSession)
    last_range = F.when(F.col("k") > chunk, F.floor((F.col("k") - 1) / F.lit(_RANGE)))
    starts = (
        groups.select(
            "g", "seed", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")
        )
        .withColumn("base", chain(F.col("seed"), F.col("b")))
        .select(
            "g", "k", "b", "base",
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.coalesce(last_range, F.lit(0)).cast("long"))
            ).alias("r"),
        )
        .repartition(parts, "g", "b", "r")
    )
    counts = (
        starts.mapInPandas(_chunk_counter(chunk), "g BIGINT, c BIGINT, b INT, start BIGINT, n BIGINT")
        .groupBy("g", "c", "b", "start")
        .agg(F.sum("n").alias("draws"))
        .repartition(parts, "g", "c")
    )
    table = indexed.select(
        "g", F.floor(F.col("idx") / F.lit(chunk)).cast("long").alias("c"), "idx", "s", "n"
    ).repartition(parts, "g", "c")
    drawn = (
        counts.groupBy("g", "c")
        .cogroup(table.groupBy("g", "c"))
        .applyInPandas(_drawn_sums, "g BIGINT, b INT, s BIGINT, n BIGINT")
    )
    return drawn.groupBy("g", "b").agg(
        (F.sum("s") / F.sum("n") / F.lit(float(_SCALE))).alias("m")
    )


def _mix(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """``mix32`` over an array of uint32, in place; products wrap at 32 bits by themselves."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, MIX_A), (15, MIX_B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def _picks(start: int, spots: np.ndarray, k: int, spare: np.ndarray) -> np.ndarray:
    """The draws ``mix32(start ^ spot) % k`` of mixed positions, as uint32.

    The remainder is taken by a quotient, which numpy vectorises for one divisor. Values are below
    2**32, so a larger ``k`` leaves them as they are.
    """
    spare = spare[: len(spots)]
    picks = _mix(np.bitwise_xor(spots, np.uint32(start)), spare)
    if k <= MASK:
        np.floor_divide(picks, np.uint32(k), out=spare)
        np.multiply(spare, np.uint32(k), out=spare)
        np.subtract(picks, spare, out=picks)
    return picks


def _chunk_counter(chunk: int):
    """Rows (g, k, b, base, r) to how often each chunk is drawn at the positions of range r.

    Positions are drawn in blocks that stay in the processor's cache, and counted without a sort.
    """

    def count(batches):
        spare = np.empty(_BLOCK, np.uint32)
        at, spots = -1, np.empty(0, np.uint32)
        for batch in batches:
            g, c, b, start, n = [], [], [], [], []
            for row in batch.itertuples(index=False):
                if row.k <= chunk:
                    chunks, draws = np.zeros(1, np.int64), np.array([row.k])
                    begin = np.array([row.base], np.int64)
                else:
                    size = min(row.k - row.r * _RANGE, _RANGE)
                    if row.r != at or size > len(spots):
                        first = row.r * _RANGE
                        spots = np.arange(first, first + size, dtype=np.uint64)
                        at, spots = row.r, _mix((spots & np.uint64(MASK)).astype(np.uint32))
                    counts = np.zeros((min(row.k - 1, MASK)) // chunk + 1, np.int64)
                    for i in range(0, size, _BLOCK):
                        picks = _picks(row.base, spots[i : min(i + _BLOCK, size)], row.k, spare)
                        np.floor_divide(picks, np.uint32(chunk), out=picks)
                        # Counts reach as far as the largest chunk drawn.
                        found = np.bincount(picks)
                        counts[: len(found)] += found
                    chunks = np.flatnonzero(counts)
                    draws = counts[chunks]
                    # Another stream per chunk, independent of the one that chose it.
                    begin = np.int64(row.base) ^ _mix((chunks + 1).astype(np.uint32)).astype(np.int64)
                g.append(np.full(len(chunks), row.g))
                b.append(np.full(len(chunks), row.b))
                c.append(chunks)
                start.append(begin)
                n.append(draws)
            if g:
                yield pd.DataFrame(
                    {
                        "g": np.concatenate(g), "c": np.concatenate(c), "b": np.concatenate(b),
                        "start": np.concatenate(start), "n": np.concatenate(n),
                    }
                )

    return count


def _drawn_sums(counts: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
    """Per replicate the sums over its draws from one chunk of clusters."""
    if counts.empty or clusters.empty:
        return pd.DataFrame({"g": [], "b": [], "s": [], "n": []}).astype("int64")
    clusters = clusters.sort_values("idx")
    values, sizes = clusters["s"].to_numpy(np.int64), clusters["n"].to_numpy(np.int64)
    most = counts["draws"].max()
    spots = _mix((np.arange(most, dtype=np.uint64) & np.uint64(MASK)).astype(np.uint32))
    spare = np.empty(_BLOCK, np.uint32)
    s = np.empty(len(counts), np.int64)
    n = np.empty(len(counts), np.int64)
    pairs = zip(counts["start"].to_numpy(), counts["draws"].to_numpy(), strict=True)
    for at, (start, draws) in enumerate(pairs):
        times = np.zeros(len(values), np.int64)
        for i in range(0, draws, _BLOCK):
            picks = _picks(start, spots[i : min(i + _BLOCK, draws)], len(values), spare)
            times += np.bincount(picks, minlength=len(values))
        s[at], n[at] = times @ values, times @ sizes
    return pd.DataFrame({"g": counts["g"], "b": counts["b"], "s": s, "n": n})


def bootstrap_bounds(
    scores: DataFrame,
    by: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """(by) -> n_clusters, n_total, mean, lo, hi.

    ``scores`` has the columns of ``by``, ``cluster`` and ``score``. ``lo`` and ``hi`` are
    the order statistics at int(.025 B) and int(.975 B), counted from zero; they are NULL
    for groups with fewer than five clusters. Writes the cluster sums to the scratch folder, without
    and with their index.
    """
    return bounds_of_sums(cluster_sums(scores, by), by, replicates, seed, chunk)


def bounds_of_sums(
    sums: DataFrame,
    by: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """``bootstrap_bounds`` from the sums (by, cluster, s, n) of its clusters."""
    by = list(by)
    keys = [F.col(c).cast("string") for c in by]
    keyed = sums.withColumn("g", hash60(joined_keys(*keys)))
    # The index reads the sums twice, which may come from tiles of runs.
    keyed = materialise(keyed, "cluster_sums")
    indexed = materialise(with_cluster_index(keyed, ["g"]), "clusters")
    groups = indexed.groupBy("g", *by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"), F.sum("s").alias("_s")
    )
    groups = groups.withColumn("seed", group_seed(seed, *keys))
    means = replicate_means(indexed, groups.where(F.col("k") >= MIN_CLUSTERS), replicates, chunk)
    sorted_means = F.array_sort(F.collect_list("m"))
    bounds = means.groupBy("g").agg(sorted_means.alias("_sorted")).select(
        "g",
        order_statistic("_sorted", replicates, 0.025).alias("lo"),
        order_statistic("_sorted", replicates, 0.975).alias("hi"),
    )
    return groups.join(bounds, "g", "left").select(
        *by,
        F.col("k").alias("n_clusters"),
        "n_total",
        (F.col("_s") / F.col("n_total") / F.lit(float(_SCALE))).alias("mean"),
        "lo",
        "hi",
    )


def order_statistic(sorted_values: str, size: int, q: float) -> Column:
    """Element int(size * q), counted from zero, of a sorted array; no interpolation."""
    return F.element_at(sorted_values, int(size * q) + 1)


def normal_half_width(p: Column, n: Column) -> Column:
    """1.96 * sqrt(p (1 - p) / n), four decimals; 0.0 without rows."""
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / F.nullif(n, F.lit(0)))
    return F.coalesce(round4(F.lit(1.96) * spread), F.lit(0.0))


def clustered_ci95(
    scores: DataFrame, by: Sequence[str], replicates: int = REPLICATES, seed: int = SEED
) -> DataFrame:
    """(by) -> ci95, the half-width of the 95 % interval; normal for few clusters."""
    return bootstrap_bounds(scores, by, replicates, seed).select(
        *by,
        F.when(
            F.col("n_clusters") >= MIN_CLUSTERS, round4((F.col("hi") - F.col("lo")) / 2)
        )
        .otherwise(normal_half_width(F.col("mean"), F.col("n_total")))
        .alias("ci95"),
    )


def plain_ci95(
    scores: DataFrame,
    by: Sequence[str],
    row_key: str,
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """As ``clustered_ci95`` with every row as its own cluster."""
    rows = scores.withColumn("cluster", F.col(row_key).cast("string"))
    return clustered_ci95(rows, by, replicates, seed)


def run_pairs(board: DataFrame) -> DataFrame:
    """Ordered pairs of leaderboard rows; there is one row per run."""
    a = board.select(F.col("rank").alias("rank_a"), F.col("run_id").alias("run_a"))
    b = board.select(F.col("rank").alias("rank_b"), F.col("run_id").alias("run_b"))
    return a.join(b, F.col("rank_a") < F.col("rank_b"))


def shared_solved(per_riddle: DataFrame, board: DataFrame) -> DataFrame:
    """Override differences on items whose original both runs solved, cluster of the first."""
    ranked = per_riddle.where("original_solved").join(
        F.broadcast(board.select("run_id", "rank")), "run_id"
    )
    a = ranked.select(
        "riddle_id",
        "cluster",
        F.col("run_id").alias("run_a"),
        F.col("rank").alias("rank_a"),
        F.col("override_mean").alias("_a"),
    )
    b = ranked.select(
        "riddle_id",
        F.col("run_id").alias("run_b"),
        F.col("rank").alias("rank_b"),
        F.col("override_mean").alias("_b"),
    )
    return (
        a.join(b, "riddle_id")
        .where("rank_a < rank_b")
        .select(
            "run_a", "rank_a", "run_b", "rank_b", "riddle_id", "cluster",
            (F.col("_a") - F.col("_b")).alias("score"),
        )
    )


def in_tiles(
    per_riddle: DataFrame, board: DataFrame, tile: int = TILE, items: int = TILE_ITEMS
) -> DataFrame:
    """Solved items beside every pair of tiles that needs them: (tile_a, tile_b, part) -> rows.

    A tile is ``tile`` consecutive ranks. A row goes to as many pairs of tiles as there are
    tiles, so items x runs^2 / ``tile`` rows are moved instead of items x runs^2 / 2.
    Items of a cluster share a part; a cluster of more than ``items`` items is spread over
    several, and there are enough parts for about ``items`` items of a run in each.
    """
    ranked = per_riddle.where("original_solved").join(board.select("run_id", "rank"), "run_id")
    ranked = ranked.withColumn("_tile", F.floor((F.col("rank") - 1) / F.lit(tile)).cast("int"))
    sizes = ranked.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.groupBy("cluster").agg(F.max("_n").alias("_n")).where(F.col("_n") > items)
    large = large.select(
        F.col("cluster").alias("_large"), F.ceil(F.col("_n") / F.lit(items)).alias("_parts")
    )
    most = sizes.groupBy("run_id").agg(F.sum("_n").alias("_n")).agg(
        F.coalesce(F.ceil(F.max("_n") / F.lit(items)), F.lit(1)).alias("_all")
    )
    tiles = board.agg(
        F.floor((F.max("rank") - 1) / F.lit(tile)).cast("int").alias("_last")
    )
    spread = with_constants(
        with_constants(
            ranked.join(large, F.col("cluster").eqNullSafe(F.col("_large")), "left"), most
        ),
        tiles,
    )
    salt = F.pmod(hash60(F.col("riddle_id")), F.coalesce("_parts", F.lit(1).cast("long")))
    part = F.pmod(hash60(F.coalesce("cluster", F.lit(""))) + salt, F.col("_all"))
    return spread.select(
        "run_id", "rank", "riddle_id", "cluster", "override_mean", "_tile",
        part.cast("long").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_other"),
    ).select(
        F.least("_tile", "_other").alias("tile_a"),
        F.greatest("_tile", "_other").alias("tile_b"),
        "part", "run_id", "rank", "riddle_id", "cluster", "override_mean",
    )


def tiled_pair_sums(
    per_riddle: DataFrame, board: DataFrame, tile: int = TILE, items: int = TILE_ITEMS
) -> DataFrame:
    """(run_a, run_b, cluster) -> s, n: ``cluster_sums`` of ``shared_solved``, tile by tile."""
    parts = in_tiles(per_riddle, board, tile, items).groupBy("tile_a", "tile_b", "part")
    sums = parts.applyInPandas(
        _pair_sums(tile), "run_a STRING, run_b STRING, cluster STRING, s BIGINT, n BIGINT"
    )
    return sums.groupBy("run_a", "run_b", "cluster").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")
    )


def _pair_sums(tile: int):
    """Cluster sums of the override differences of all pairs of runs of two tiles."""

    def sums(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        columns, _ = pd.factorize(rows["riddle_id"], use_na_sentinel=False)
        clusters, names = pd.factorize(rows["cluster"], use_na_sentinel=False)
        runs = rows[["run_id", "rank"]].drop_duplicates().sort_values("rank", kind="stable")
        line = rows["run_id"].map({r: i for i, r in enumerate(runs["run_id"])}).to_numpy()
        shape = (len(runs), columns.max() + 1)
        held, value = np.zeros(shape, bool), np.full(shape, np.nan)
        cluster = np.zeros(shape, np.int64)
        held[line, columns] = True
        value[line, columns] = rows["override_mean"].to_numpy(float)
        cluster[line, columns] = clusters
        ranks, ids = runs["rank"].to_numpy(), runs["run_id"].to_numpy()
        of = (ranks - 1) // tile
        found = []
        for a in np.flatnonzero(of == key[0]):
            others = np.flatnonzero((of == key[1]) & (ranks > ranks[a]))
            mine = np.flatnonzero(held[a])
            if not len(others) or not len(mine):
                continue
            mine = mine[np.argsort(cluster[a, mine], kind="stable")]
            present, starts = np.unique(cluster[a, mine], return_index=True)
            scaled = (value[a, mine] - value[np.ix_(others, mine)]) * _SCALE
            units = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
            both = held[np.ix_(others, mine)]
            whole = np.where(both & ~np.isnan(units), units, 0).astype(np.int64)
            s = np.add.reduceat(whole, starts, axis=1)
            n = np.add.reduceat(both.astype(np.int64), starts, axis=1)
            b, c = np.nonzero(n)
            found.append(
                pd.DataFrame(
                    {
                        "run_a": ids[a], "run_b": ids[others[b]],
                        "cluster": np.asarray(names, object)[present[c]],
                        "s": s[b, c], "n": n[b, c],
                    }
                )
            )
        if not found:
            return pd.DataFrame(columns=["run_a", "run_b", "cluster", "s", "n"], dtype=object)
        return pd.concat(found).astype({"run_a": object, "run_b": object, "cluster": object})

    return sums


def pair_signs(
    per_riddle: DataFrame,
    board: DataFrame,
    replicates: int = REPLICATES,
    seed: int = SEED,
) -> DataFrame:
    """(run_a, run_b) -> sign: 1 if a is significantly better, -1 if b is, else 0.

    The draw seed of a pair is a function of the two run ids, so results are repeatable.
    Pairs with fewer than five shared clusters are inconclusive.
    """
    bounds = bounds_of_sums(
        tiled_pair_sums(per_riddle, board), ["run_a", "run_b"], replicates, seed
    )
    sign = F.when(F.col("hi") < 0, 1).when(F.col("lo") > 0, -1).otherwise(0)
    return run_pairs(board).join(bounds, ["run_a", "run_b"], "left").select(
        "run_a", "rank_a", "run_b", "rank_b", sign.alias("sign")
    )


def rank_spread(board: DataFrame, signs: DataFrame) -> DataFrame:
    """(run_id) -> rank_best, rank_worst; a single run gets 1 and 1."""
    seen_by_b = signs.select(F.col("run_b").alias("run_id"), F.col("sign").alias("other_better"))
    seen_by_a = signs.select(F.col("run_a").alias("run_id"), (-F.col("sign")).alias("other_better"))
    counts = (
        seen_by_b.union(seen_by_a)
        .groupBy("run_id")
        .agg(
            F.count_if(F.col("other_better") > 0).alias("_better"),
            F.count_if(F.col("other_better") >= 0).alias("_not_worse"),
        )
    )
    return board.select("run_id").join(counts, "run_id", "left").select(
        "run_id",
        (1 + F.coalesce("_better", F.lit(0))).alias("rank_best"),
        (1 + F.coalesce("_not_worse", F.lit(0))).alias("rank_worst"),
    )
