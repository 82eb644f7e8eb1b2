"""Positions, first/last rules and representatives without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.text import numbered_id

#: Of an order value: those inside a block, and those that tell apart the blocks of a coarser one.
_BITS, _COARSE_BITS = 13, 25


def global_rank(
    df: DataFrame,
    order: str | Column,
    by: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    name: str = "rank",
    start: int = 1,
) -> DataFrame:
    """Add the position of each row in ``order`` (BIGINT), per ``by`` group.

    A window over the whole table would sort it in one task. Here rows are windowed inside
    blocks of 2**13 consecutive order values, and each block gets the number of rows before
    it from two levels of block counts. With a unique ``order`` no window sees more than
    2**13 rows, however wide they are, whatever the size of the table or of one group; the windows
    over counts see one narrow row per block that has rows, 2**26 of them at most.
    ``tiebreak`` orders the few rows that may share a value.
    """
    by = list(by)
    order = F.col(order) if isinstance(order, str) else order
    keyed = df.withColumn("_k", order.cast("long")).withColumn("_b0", F.shiftright("_k", _BITS))
    for i, c in enumerate(by):
        keyed = keyed.withColumn(f"_g{i}", F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    groups = [f"_g{i}" for i in range(len(by))]

    blocks = keyed.groupBy(*groups, "_b0").agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_b1", F.shiftright("_b0", _COARSE_BITS))
    earlier = (Window.unboundedPreceding, -1)
    fine = blocks.withColumn(
        "_o0",
        F.sum("_n").over(
            Window.partitionBy(*groups, "_b1").orderBy("_b0").rowsBetween(*earlier)
        ),
    )
    coarse = (
        blocks.groupBy(*groups, "_b1")
        .agg(F.sum("_n").alias("_m"))
        .withColumn(
            "_o1",
            F.sum("_m").over(
                Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_b1").rowsBetween(*earlier)
            ),
        )
        .drop("_m")
    )
    offsets = fine.join(coarse, [*groups, "_b1"]).select(
        *groups,
        "_b0",
        (F.coalesce("_o0", F.lit(0)) + F.coalesce("_o1", F.lit(0))).alias("_off"),
    )
    inside = F.row_number().over(
        Window.partitionBy(*groups, "_b0").orderBy("_k", *[F.col(c) for c in tiebreak])
    )
    return (
        keyed.withColumn("_rn", inside)
        .join(offsets, [*groups, "_b0"])
        .withColumn(name, F.col("_off") + F.col("_rn") + F.lit(start - 1))
        .drop(*groups, "_k", "_b0", "_rn", "_off")
        .select(*[c for c in df.columns if c != name], name)
    )


def with_sequential_id(
    df: DataFrame, prefix: str, base: int | DataFrame = 0, order: str = "ord", name: str = "id"
) -> DataFrame:
    """Ids ``prefix0001`` ... in order, continuing after ``base``.

    ``base`` is a number or a one-row DataFrame with the column ``base``.
    """
    ranked = global_rank(df.drop(name), order, name="_pos")
    if isinstance(base, DataFrame):
        ranked = with_constants(ranked, base)
        number = F.col("_pos") + F.col("base")
    else:
        number = F.col("_pos") + F.lit(base)
    out = ranked.withColumn(name, numbered_id(prefix, number))
    return out.drop("_pos", "base")


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row.

    No row gives NULLs; more than one is an error, which also bounds what is broadcast.
    """
    key = "_const"
    row = F.any_value(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]))
    several = F.raise_error(F.lit("a table of constants has more than one row"))
    right = one_row.agg(F.when(F.count(F.lit(1)) <= 1, row).otherwise(several).alias("_row"))
    right = right.select("_row.*").withColumn(key, F.lit(1))
    return (
        df.withColumn(key, F.lit(1)).join(F.broadcast(right), key, "left").drop(key)
    )


def zero_based_index(df: DataFrame, order: str = "ord", name: str = "riddle_idx") -> DataFrame:
    """Position of each row in ``order``, from zero."""
    return global_rank(df, order, name=name, start=0)


def first_wins(df: DataFrame, keys: Sequence[str], order: str | Column = "ord") -> DataFrame:
    """The first row of each key. Aggregates before the shuffle, so hot keys stay cheap."""
    return _winner(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: str | Column = "ord") -> DataFrame:
    """The last row of each key."""
    return _winner(df, keys, order, F.max_by)


def _winner(df: DataFrame, keys: Sequence[str], order: str | Column, pick) -> DataFrame:
    keys = list(keys)
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    won = df.groupBy(*keys).agg(pick(row, order).alias("_row"))
    return won.select(
        *[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    )


def representative_samples(details: DataFrame) -> DataFrame:
    """One sample per (run, item, variant): index 1 if there is one, else the first."""
    preference = F.struct(
        (F.coalesce("sample_index", F.lit(1)) != 1).alias("a"), F.col("ord").alias("b")
    )
    return first_wins(details, ["run_id", "riddle_id", "riddle_type"], preference)


def union_in_order(first: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """UNION ALL by name in which every row of ``second`` comes after ``first``.

    The second part continues after the largest value of the first, so unions can be chained.
    """
    ends = first.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_base"))
    starts = second.agg(F.coalesce(F.min(order), F.lit(0)).alias("_least"))
    moved = with_constants(with_constants(second, ends), starts)
    moved = moved.withColumn(order, F.col(order) - F.col("_least") + F.col("_base"))
    return first.unionByName(moved.drop("_base", "_least"), allowMissingColumns=True)
