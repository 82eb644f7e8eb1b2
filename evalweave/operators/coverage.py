"""Which items a complete run must cover, and which runs do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.ordering import with_constants
from evalweave.session import materialise


def expected_coverage(entries: DataFrame) -> DataFrame:
    """Distinct (riddle_type, riddle_id): every item altered, the first per original once."""
    known = entries.where(F.coalesce("id", F.lit("")) != "")
    altered = known.select(F.lit("altered").alias("riddle_type"), F.col("id").alias("riddle_id"))
    original = (
        known.where(F.coalesce("original_riddle", F.lit("")) != "")
        .groupBy("original_riddle")
        .agg(F.min_by("id", "ord").alias("riddle_id"))
        .select(F.lit("original").alias("riddle_type"), "riddle_id")
    )
    return altered.union(original).distinct()


def covered(details: DataFrame) -> DataFrame:
    """Distinct (run, variant, item) that were evaluated."""
    return (
        details.where(F.coalesce("riddle_id", F.lit("")) != "")
        .select("run_id", "riddle_type", "riddle_id")
        .distinct()
    )


def coverage_report(
    runs: DataFrame, details: DataFrame, entries: DataFrame, unique: bool = False
) -> DataFrame:
    """Expected and missing counts per run.

    Counting the expected items that a run has covers the division in one linear join; the
    product of runs and items is never built. ``unique`` says that no (run, variant, item)
    stands in two rows of ``details``, which saves a shuffle of them.
    """
    expected = expected_coverage(entries)
    is_altered = F.col("riddle_type") == "altered"
    totals = expected.agg(
        F.count_if(is_altered).alias("expected_altered"),
        F.count_if(~is_altered).alias("expected_original"),
    )
    have = (
        (details if unique else covered(details))
        .join(expected, ["riddle_type", "riddle_id"])
        .groupBy("run_id")
        .agg(
            F.count_if(is_altered).alias("_altered"), F.count_if(~is_altered).alias("_original")
        )
    )
    return with_constants(runs.select("run_id").join(have, "run_id", "left"), totals).select(
        "run_id",
        "expected_altered",
        (F.col("expected_altered") - F.coalesce("_altered", F.lit(0))).alias("missing_altered"),
        "expected_original",
        (F.col("expected_original") - F.coalesce("_original", F.lit(0))).alias(
            "missing_original"
        ),
    )


def complete_runs(
    runs: DataFrame, details: DataFrame, entries: DataFrame, unique: bool = False
) -> DataFrame:
    """Runs that miss nothing; without expectations, all runs."""
    report = coverage_report(runs, details, entries, unique)
    keep = report.where("missing_altered = 0 AND missing_original = 0").select("run_id")
    return runs.join(keep, "run_id", "left_semi")


def missing_items(runs: DataFrame, details: DataFrame, entries: DataFrame) -> DataFrame:
    """(run, variant, item) expected but absent, for incomplete runs only.

    Incomplete runs are numbered from 1. Per item the numbers of the runs that have it are sorted, and the
    gaps between them are the missing runs, so an item's row carries numbers of its own runs
    only and gives a row per missing one.
    """
    item = ["riddle_type", "riddle_id"]
    report = coverage_report(runs, details, entries)
    short = report.where("missing_altered > 0 OR missing_original > 0").select("run_id").distinct()
    # One row per incomplete run.
    numbered = short.withColumn("_no", F.row_number().over(Window.orderBy("run_id")))
    numbered = materialise(numbered, "short_runs")
    have = (
        covered(details)
        .join(numbered, "run_id")
        .groupBy(*item)
        .agg(F.array_sort(F.collect_set("_no")).alias("_have"))
    )
    count = numbered.agg(F.count(F.lit(1)).cast("int").alias("_runs"))
    wanted = with_constants(expected_coverage(entries).join(have, item, "left"), count).where("_runs > 0")
    ends = F.concat(
        F.array(F.lit(0)), F.coalesce("_have", F.array().cast("array<int>")), F.array(F.col("_runs") + 1)
    )
    gaps = F.zip_with(
        F.slice(ends, 1, F.size(ends) - 1),
        F.slice(ends, 2, F.size(ends) - 1),
        lambda a, b: F.when(b - a > 1, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<int>")),
    )
    absent = wanted.select(*item, F.explode(F.flatten(gaps)).alias("_no"))
    return absent.join(numbered, "_no").select("run_id", *item)
