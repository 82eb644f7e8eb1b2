"""Moving pool items into the fixed and auxiliary sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evalweave.functions.text import numbered_id
from evalweave.operators.ordering import with_constants
from evalweave.operators.selection import (
    balanced_pick,
    max_id_number,
    pool_report,
)
from evalweave.sources.documents import snapshot

CAP = 3


def clamp(pool: DataFrame, count: int) -> DataFrame:
    """One row: ``count``, at most the pool's rows (used ones count too)."""
    return pool.agg(F.least(F.lit(count).cast("long"), F.count(F.lit(1))).alias("count"))


def split_sizes(pool: DataFrame, fixed: int, auxiliary: int) -> DataFrame:
    """One row (n_fixed, n_auxiliary), shrunk in proportion when the pool is short."""
    n = F.count(F.lit(1))
    total = fixed + auxiliary
    fits = n >= total
    shrunk = F.floor(n * F.lit(fixed / total if total else 0.0)).cast("long")
    n_fixed = F.when(fits, F.lit(fixed).cast("long")).otherwise(shrunk)
    return pool.agg(
        n_fixed.alias("n_fixed"),
        F.when(fits, F.lit(auxiliary).cast("long")).otherwise(n - n_fixed).alias("n_auxiliary"),
    )


def _entries(selected: DataFrame, set_name: str, base: DataFrame | int) -> DataFrame:
    """Selected items as entries; ids follow the pick order after ``base``."""
    if isinstance(base, DataFrame):
        placed = with_constants(selected, base)
    else:
        placed = selected.withColumn("base", F.lit(base).cast("long"))
    return placed.withColumns(
        {
            "id": numbered_id("alt_", F.col("base") + F.col("pick")),
            "set": F.lit(set_name),
            "ord": F.col("base") + F.col("pick"),
        }
    ).drop("base", "pick")


def promote_add(
    pool: DataFrame,
    auxiliary: DataFrame,
    fixed: DataFrame,
    count: int,
    set_name: str = "auxiliary",
    cap: int | None = CAP,
) -> tuple[DataFrame, DataFrame]:
    """(entries to append, pool after). Ids continue after the largest of both sets."""
    if set_name not in ("fixed", "auxiliary"):
        raise ValueError("set_name must be fixed or auxiliary")
    existing = auxiliary.select("id", "original_riddle").union(fixed.select("id", "original_riddle"))
    selected, after = balanced_pick(pool, clamp(pool, count), cap, existing)
    return _entries(selected, set_name, max_id_number(existing)), after


def refresh_auxiliary(
    pool: DataFrame,
    fixed: DataFrame,
    count: int,
    cap: int | None = CAP,
    old: DataFrame | None = None,
    folder: str | None = None,
    stamp: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new auxiliary set, pool after).

    Pool items of the old set stay used, and ids follow the largest fixed one. With ``old``,
    the set about to be replaced, its snapshot ``<folder>/benchmark_<stamp>`` is stored before
    anything is picked; a snapshot that exists already fails the refresh.
    """
    if old is not None:
        if folder is None or stamp is None:
            raise ValueError("a snapshot needs folder and stamp")
        snapshot(old, folder, stamp)
    selected, after = balanced_pick(pool, clamp(pool, count), cap, fixed)
    return _entries(selected, "auxiliary", max_id_number(fixed)), after


def promote_split(
    pool: DataFrame,
    n_fixed: int,
    n_auxiliary: int,
    cap: int | None = CAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixed, auxiliary, pool after) in one go; ids start at 1, fixed first.

    The auxiliary pick sees the fixed items in its quota.
    """
    sizes = split_sizes(pool, n_fixed, n_auxiliary)
    first, remaining = balanced_pick(pool, sizes.select(F.col("n_fixed").alias("count")), cap, None)
    fixed = _entries(first, "fixed", 0)
    second, after = balanced_pick(
        remaining, sizes.select(F.col("n_auxiliary").alias("count")), cap, fixed
    )
    auxiliary = _entries(second, "auxiliary", max_id_number(fixed))
    return fixed, auxiliary, after


def pool_status(auxiliary: DataFrame, fixed: DataFrame, pool: DataFrame) -> DataFrame:
    return pool_report(auxiliary, fixed, pool)


def observed_promotion(
    entries: DataFrame, after: DataFrame, observations: tuple[Observation, Observation]
) -> tuple[DataFrame, DataFrame]:
    """The same tables; when they are stored, the first observation receives ``promoted``, the
    second ``pending`` and ``used``. No second pass."""
    used = F.coalesce("used_in_set", F.lit(False))
    return (
        entries.observe(observations[0], F.count(F.lit(1)).alias("promoted")),
        after.observe(observations[1], F.count_if(~used).alias("pending"), F.count_if(used).alias("used")),
    )


def promotion_counts(after: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: promoted, pending and used."""
    promoted = entries.agg(F.count(F.lit(1)).alias("promoted"))
    used = F.coalesce("used_in_set", F.lit(False))
    pool = after.agg(F.count_if(~used).alias("pending"), F.count_if(used).alias("used"))
    return with_constants(promoted, pool)
