"""Skipping work that is already done, and attaching what is known."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import pair_key, text_key
from evalweave.operators.ordering import last_wins

OUTPUT_KEY = ("run_id", "riddle_id", "riddle_type", "sample_index")
SANITY_KEY = ("solver", "riddle_idx")
ITEM_SIDES = ("original_riddle", "altered_riddle")


def without_done(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join on ``keys``; a NULL sample index means 1 on both sides."""
    keys = list(keys)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"_{k}": F.coalesce(k, F.lit(1)) if k == "sample_index" else F.col(k)
                for k in keys
            }
        )

    marked = [f"_{k}" for k in keys]
    right = keyed(done).select(*marked).distinct()
    return keyed(tasks).join(right, marked, "left_anti").select(*tasks.columns)


def pending_tasks(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    keys = [k for k in OUTPUT_KEY if k in tasks.columns and k in outputs.columns]
    return without_done(tasks, outputs, keys)


def pending_judgments(outputs: DataFrame, judgments: DataFrame) -> DataFrame:
    return without_done(outputs, judgments, OUTPUT_KEY)


def pending_sanity(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    return without_done(answers, judgments, SANITY_KEY)


def content_keys(*tables: DataFrame) -> DataFrame:
    """Distinct content keys of several tables; rows with an empty side have none."""
    parts = [t.select(pair_key(*ITEM_SIDES).alias("_key")) for t in tables]
    keys = parts[0]
    for part in parts[1:]:
        keys = keys.union(part)
    return keys.where(F.col("_key").isNotNull()).distinct()


def content_digest() -> Column:
    """SHA-256 of an item's content key, 32 bytes that stand for both texts in joins.

    NULL for an item with an empty side. The key is digested as JSON, which keeps its two sides apart.
    """
    return F.unhex(F.sha2(F.to_json(pair_key(*ITEM_SIDES)), 256))


def without_content(items: DataFrame, *done: DataFrame) -> DataFrame:
    """Items whose content key occurs in none of ``done``.

    An item with an empty side has a NULL key, which matches nothing, so it is kept.
    Repeats inside ``items`` are kept too. Of ``done`` only digests are shuffled; an anti join
    needs no distinct ones, so each is shuffled once.
    """
    digests = [t.select(content_digest().alias("_digest")).where("_digest IS NOT NULL") for t in done]
    return (
        items.withColumn("_digest", content_digest())
        .join(reduce(DataFrame.union, digests), "_digest", "left_anti")
        .drop("_digest")
    )


def with_judgments(outputs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Left join of the last judgment per key; where there is none, all flags are false."""
    keys = list(OUTPUT_KEY)
    flags = ("correct", "gave_original", "competing")
    # Packed into one number, the last verdict is found by a hashed aggregate.
    packed = sum(
        F.when(F.coalesce(f"judgment.{flag}", F.lit(False)), F.lit(1 << bit)).otherwise(F.lit(0))
        for bit, flag in enumerate(flags)
    )
    known = (
        judgments.withColumn("sample_index", F.coalesce("sample_index", F.lit(1)))
        .groupBy(*keys)
        .agg(F.max_by(packed.cast("long"), "ord").alias("_verdict"))
    )
    verdict = F.coalesce("_verdict", F.lit(0))
    return (
        outputs.withColumn("sample_index", F.coalesce("sample_index", F.lit(1)))
        .join(known, keys, "left")
        .withColumns(
            {flag: verdict.bitwiseAND(1 << bit) != 0 for bit, flag in enumerate(flags)}
        )
        .drop("_verdict")
    )


def with_entries(outputs: DataFrame, entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join of outputs with the last entry per id; unknown ids drop out."""
    known = last_wins(entries.select("id", "ord", *columns), ["id"]).drop("ord")
    return outputs.join(known.withColumnRenamed("id", "riddle_id"), "riddle_id")


def representation_counts(items: DataFrame) -> DataFrame:
    """Rows per original text key; empty originals do not count."""
    return (
        items.select(text_key("original_riddle").alias("original_key"))
        .where("original_key <> ''")
        .groupBy("original_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_representation(source: DataFrame, items: DataFrame, text: str = "riddle") -> DataFrame:
    """Left join of how often each source text was used, 0 by default."""
    return (
        source.withColumn("original_key", text_key(text))
        .join(representation_counts(items), "original_key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .drop("original_key")
    )


def common_items(sanity: DataFrame, min_accuracy: float = 0.6) -> DataFrame:
    """Items solved often enough; a missing accuracy counts as zero."""
    return sanity.where(F.coalesce("mean_accuracy", F.lit(0.0)) >= min_accuracy)


def only_common(source: DataFrame, sanity: DataFrame | None, min_accuracy: float = 0.6) -> DataFrame:
    """Semi join of source items with the common ones; without sanity results, all items."""
    if sanity is None:
        return source
    keep = common_items(sanity, min_accuracy).select("riddle_idx")
    return source.join(keep, "riddle_idx", "left_semi")
