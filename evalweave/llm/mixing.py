"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the words of all sources are shared by weight; no target exceeds ``most`` times its
source, the excess is reshared by weight among the others. Every source is a stream of its
documents in a fixed random order, run through again where the target asks for more than the
source has. The stream up to the target is cut into blocks of about ``block_words`` words. A
document belongs to the pass and block that holds its middle word, so the taken words miss
the target by less than half a document, and no document is taken more than ``most`` times.

The blocks are dealt to the output shards by recursive halving: a node holds a block quota
per source, and its left half gets a multivariate-hypergeometric draw of them, seeded by
(seed, node). Every leaf walks down from the root alone, so shards need no common state, the
quotas of all shards add up exactly, and a retried task draws the same. A shard's blocks of
a source are the next ``quota`` ones of its permuted stream, so shards are disjoint.
Inside a shard rows are shuffled by hash.

Defined results: null text or text without words has size 0 and is never taken; a null
source is a source of its own, last in order; a source without words has target 0; repeated
rows are documents of their own; an empty table gives an empty mix. Other columns are kept by
``mixture`` and ignored otherwise.

Scale: the order inside a source is a running sum over hash buckets of a few thousand
documents plus bucket offsets, so a source with a third of all rows is no single task's load.
Every task holds one quota per source; more than ``_MOST_SOURCES`` sources are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import WORD, fresh, numbered_rows, quoted
from evalweave.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
_BUCKET_ROWS = 4096
_MOST_SOURCES = 1_000_000
#: Of all blocks together, so that the draws stay within exact integers.
_MOST_BLOCKS = 500_000_000


def sized(docs: DataFrame, row: Column, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size, h): h places a document in the order of its source."""
    size = F.coalesce(F.regexp_count(quoted("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        row.alias("row"),
        quoted(key).alias("doc_id"),
        quoted(source).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(F.lit("mix order"), quoted(key), quoted("text")).alias("h"),
    )


def source_targets(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0
) -> DataFrame:
    """(source, n, source_size, weight, target, place), one row per source.

    Sources are few: windows over this table hold one row each.
    """
    table = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod("place", F.lit(len(weights))) + 1
    table = table.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    )
    # Fill up by weight: sources are capped in the order of cap / weight. A source is
    # capped if the level that the sources before it leave is above its own.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = table.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", level)
    filled = filled.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "place", "level")))
    return filled.withColumn("last", final.over(every)["level"]).select(
        "source",
        "n",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("last") * F.col("weight")).alias("target"),
        "place",
    )


def placed_in_source(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_size, target, place and ``mid``, the words of the source before a
    document's middle in the fixed random order."""
    joined = rows.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s")
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    bucket = F.floor(share * F.ceil(F.col("n") / _BUCKET_ROWS))
    joined = joined.withColumn("bucket", bucket)
    sums = joined.groupBy("place", "bucket").agg(F.sum("size").alias("_w"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "place", "bucket", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy("place", "bucket")
        .orderBy(F.shiftrightunsigned("h", 1), "h", "row")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = joined.withColumn("_upto", F.sum("size").over(inside))
    mid = F.col("_before") + F.col("_upto") - F.col("size") / 2
    return joined.join(sums, ["place", "bucket"]).withColumn("mid", mid).drop(
        "_before", "_upto", "bucket"
    )


def shard_quotas(
    blocks: Sequence[int], shard: int, shards: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """(quota, offset) per source of one shard, by the walk from the root to its leaf."""
    quota = np.asarray(blocks, np.int64)
    offset = np.zeros(len(quota), np.int64)
    total = int(quota.sum())
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        slots = middle * total // shards - low * total // shards
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quota, slots, method="marginals")
        if shard < middle:
            quota, high = left, middle
        else:
            quota, offset, low = quota - left, offset + left, middle
    return quota, offset


def mix(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    block_words: int = 1 << 16,
    shard_blocks: int = 64,
    seed: int = 13,
) -> tuple[DataFrame, DataFrame]:
    """(mixed, targets) of a stored table from ``sized``.

    ``mixed``: row, copy (pass of its source, from 0), shard, position in the shard, for
    every document as often as it is taken.
    """
    targets = materialise(source_targets(rows, weights, most), "targets")
    if targets.count() > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} sources")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    width = max(block_words, math.ceil(total / _MOST_BLOCKS))
    held = targets.orderBy("place").select("target").collect()
    blocks = [math.ceil(r["target"] / width) for r in held]
    shards = max(1, math.ceil(sum(blocks) / shard_blocks))
    spark = rows.sparkSession

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                quota, offset = shard_quotas(blocks, int(shard), shards, seed)
                some = np.flatnonzero(quota)
                yield pd.DataFrame(
                    {"place": some, "offset": offset[some], "quota": quota[some], "shard": int(shard)}
                )

    dealt = (
        spark.range(shards)
        .mapInPandas(deal, "place long, offset long, quota long, shard long")
        .select("place", "shard", F.explode(F.expr("sequence(offset, offset + quota - 1)")).alias("block"))
    )
    copies = placed_in_source(rows, targets).where("size > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))
    )
    at = F.col("copy") * F.col("source_size") + F.col("mid")
    copies = copies.where(at < F.col("target")).select(
        "row", "copy", F.col("place").cast("long").alias("place"), F.floor(at / width).alias("block")
    )
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "row", "copy"), "row", "copy")
    mixed = copies.join(dealt, ["place", "block"]).select(
        "row", "copy", "shard", (F.row_number().over(order) - 1).cast("long").alias("position")
    )
    return mixed, targets


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every document."""
    rows = materialise(sized(docs, F.monotonically_increasing_id()), "sizes")
    mixed, targets = mix(rows, **settings)
    taken = mixed.groupBy("row").agg(
        F.count(F.lit(1)).alias("times"), F.array_sort(F.collect_list("shard")).alias("shards")
    )
    sources = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        rows.join(taken, "row", "left")
        .join(sources, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"),
            F.coalesce(F.array_join(F.col("shards").cast("array<string>"), ","), F.lit("")).alias("shards"),
        )
    )


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs`` and mix_copy, mix_shard, mix_position.

    Ordering a shard's rows by position gives its training order.
    """
    row = fresh(docs, "_row")
    held = numbered_rows(docs, row, "mixture")
    mixed, _ = mix(materialise(sized(held, quoted(row)), "sizes"), **settings)
    names = {n: fresh(docs, f"mix_{n}") for n in ("copy", "shard", "position")}
    chosen = mixed.select(F.col("row").alias(row), *[F.col(n).alias(o) for n, o in names.items()])
    return held.join(chosen, row).drop(row)
