"""Metrics of evaluated samples.

``details`` is the flat table of judged samples: run_id, riddle_id, riddle_type,
sample_index, correct, gave_original_answer, ord. Each metric is one shuffle on
(run, item) followed by a small one on the run; both pre-aggregate, so neither a run nor an
item that holds a large share of the rows ends up whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import ratio, round4, steady_mean
from evalweave.operators.ordering import last_wins
from evalweave.schemas import ALTERATION_TYPES


def flag(name: str) -> Column:
    return F.coalesce(name, F.lit(False)).cast("long")


def detail_rows(judged: DataFrame) -> DataFrame:
    """Detail projection; the two override columns exist only for altered rows."""
    altered = F.col("riddle_type") == "altered"
    return judged.select(
        "run_id",
        "ord",
        "riddle_id",
        "riddle_type",
        F.coalesce("sample_index", F.lit(1)).alias("sample_index"),
        F.coalesce("model_answer", F.lit("")).alias("model_answer"),
        "correct",
        F.when(altered, F.col("gave_original")).alias("gave_original_answer"),
        F.when(altered, F.coalesce("original_answer", F.lit(""))).alias("original_answer"),
    )


def item_sums(details: DataFrame) -> DataFrame:
    """(run, item) sums over both variants, with the representative sample of each.

    All metrics below follow from these rows, so a caller that needs several of them stores
    this table once. The order of preference is one BIGINT, which keeps the aggregation
    hashed on both sides of the shuffle.
    """
    altered = F.col("riddle_type") == "altered"
    original = F.col("riddle_type") == "original"
    later = F.when(F.coalesce("sample_index", F.lit(1)) != 1, F.lit(2**62)).otherwise(F.lit(0))
    preference = later + F.col("ord")
    return details.groupBy("run_id", "riddle_id").agg(
        F.count(F.when(altered, 1)).alias("n"),
        F.sum(F.when(altered, flag("correct"))).alias("n_correct"),
        F.sum(F.when(altered, flag("gave_original_answer"))).alias("n_override"),
        F.count(F.when(original, 1)).alias("n_original"),
        F.sum(F.when(original, flag("correct"))).alias("n_original_correct"),
        F.min_by(flag("correct"), F.when(altered, preference)).alias("rep_correct"),
        F.min_by(flag("gave_original_answer"), F.when(altered, preference)).alias("rep_override"),
        F.min_by(flag("correct"), F.when(original, preference)).alias("rep_original_correct"),
    )


def run_summary(details: DataFrame) -> DataFrame:
    """``items_summary`` straight from the details."""
    return items_summary(item_sums(details))


def items_summary(item: DataFrame) -> DataFrame:
    """Accuracy and override rates per run, from ``item_sums``.

    Totals use the representative sample of each item. The conditioned rate averages, over
    items whose original was solved by any sample, the share of samples that gave the
    original answer.
    """
    conditioned = (F.col("n") > 0) & (F.coalesce("n_original_correct", F.lit(0)) > 0)
    original_total = F.count(F.when(F.col("n_original") > 0, 1))
    altered_total = F.count(F.when(F.col("n") > 0, 1))
    total = F.coalesce(F.sum("rep_correct"), F.lit(0))
    original_correct = F.coalesce(F.sum("rep_original_correct"), F.lit(0))
    override = F.coalesce(F.sum("rep_override"), F.lit(0))
    return item.groupBy("run_id").agg(
        original_total.alias("original_total"),
        original_correct.alias("original_correct"),
        round4(ratio(original_correct, original_total)).alias("original_accuracy"),
        altered_total.alias("altered_total"),
        total.alias("altered_correct"),
        round4(ratio(total, altered_total)).alias("altered_accuracy"),
        round4(ratio(override, altered_total)).alias("pattern_override_rate"),
        F.count(F.when(conditioned, 1)).alias("conditioned_override_total"),
        F.coalesce(F.sum(F.when(conditioned, F.col("n_override"))), F.lit(0)).alias(
            "conditioned_override_count"
        ),
        round4(
            F.coalesce(
                steady_mean(F.when(conditioned, F.col("n_override") / F.col("n"))), F.lit(0.0)
            )
        ).alias("conditioned_override_rate"),
    )


def token_totals(outputs: DataFrame) -> DataFrame:
    """Token sums per run over all outputs, unknown items included; 0 where none is known."""
    return outputs.groupBy("run_id").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
    )


def item_samples(item: DataFrame) -> DataFrame:
    """(run, variant, item) of ``item_sums``: what a coverage test needs of the details."""
    variants = F.array(
        F.when(F.col("n") > 0, F.lit("altered")), F.when(F.col("n_original") > 0, F.lit("original"))
    )
    return item.select(
        "run_id", "riddle_id", F.explode(F.array_compact(variants)).alias("riddle_type")
    )


def per_riddle_stats(
    details: DataFrame, entries: DataFrame | None = None, condition_on: str = "riddle_id"
) -> DataFrame:
    """``items_stats`` straight from the details."""
    return items_stats(item_sums(details), entries, condition_on)


def items_stats(
    item: DataFrame, entries: DataFrame | None = None, condition_on: str = "riddle_id"
) -> DataFrame:
    """One row per (run, altered item) with means over its samples, from ``item_sums``.

    ``cluster`` is the entry's original text, or the item id where the entry is unknown.
    An original is asked once, under the first entry's id, so by default only that entry
    can count as solved; ``condition_on="original_text"`` extends it to all entries that
    share the original.
    """
    stats = item.where(F.coalesce("riddle_id", F.lit("")) != "").select(
        "run_id",
        "riddle_id",
        "n",
        "n_override",
        "n_correct",
        "n_original",
        F.coalesce("n_original_correct", F.lit(0)).alias("n_original_correct"),
    )
    if entries is None:
        stats = stats.withColumn("cluster", F.col("riddle_id"))
    else:
        lookup = last_wins(
            entries.where(F.coalesce("id", F.lit("")) != "").select(
                F.col("id").alias("riddle_id"), "ord", "original_riddle", F.lit(True).alias("_known")
            ),
            ["riddle_id"],
        ).drop("ord")
        stats = stats.join(lookup, "riddle_id", "left").withColumn(
            "cluster", F.coalesce("original_riddle", "riddle_id")
        )
    if condition_on == "original_text":
        by_text = stats.groupBy("run_id", "cluster").agg(
            F.sum("n_original").alias("n_original"),
            F.sum("n_original_correct").alias("n_original_correct"),
        )
        stats = stats.drop("n_original", "n_original_correct").join(
            by_text, ["run_id", "cluster"]
        )
    elif condition_on != "riddle_id":
        raise ValueError("condition_on must be riddle_id or original_text")
    return stats.where("n > 0").select(
        "run_id",
        "riddle_id",
        "cluster",
        (F.col("n_override") / F.col("n")).alias("override_mean"),
        (F.col("n_correct") / F.col("n")).alias("accuracy_mean"),
        F.col("n").alias("sample_count"),
        F.col("n_override").alias("override_samples"),
        F.when(F.col("n_original") > 0, F.col("n_original_correct") / F.col("n_original")).alias(
            "original_accuracy_mean"
        ),
        (F.col("n_original_correct") > 0).alias("original_solved"),
    )


def board_metrics(per_riddle: DataFrame, summary: DataFrame) -> DataFrame:
    """Leaderboard metrics per run.

    ``summary`` holds one row per run with the run's metadata, summary and token totals. A
    run without altered rows keeps the values of its summary.
    ``conditioned_override_total`` counts samples here, but items in the summary.
    """
    solved = F.col("original_solved")
    agg = per_riddle.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("unique_altered_riddles"),
        steady_mean(F.col("accuracy_mean")).alias("_accuracy"),
        F.avg("sample_count").alias("avg_samples_per_riddle"),
        F.sum("sample_count").alias("_samples"),
        F.count(F.when(solved, 1)).alias("conditioned_unique_altered_riddles"),
        steady_mean(F.when(solved, F.col("override_mean"))).alias("_cor"),
        F.sum(F.when(solved, F.col("override_samples"))).alias("_override_samples"),
    )
    seen = F.coalesce("unique_altered_riddles", F.lit(0)) > 0
    s = summary.alias("s").join(agg, "run_id", "left")
    return s.select(
        "run_id",
        "run_ord",
        "model",
        "provider",
        "quantization",
        "reasoning_enabled",
        "reasoning_effort",
        "original_accuracy",
        F.when(seen, F.col("_accuracy"))
        .otherwise(F.col("s.altered_accuracy"))
        .alias("altered_accuracy"),
        "pattern_override_rate",
        F.when(seen, F.coalesce("_cor", F.lit(0.0)))
        .otherwise(F.col("s.conditioned_override_rate"))
        .alias("conditioned_override_rate"),
        F.when(seen, F.coalesce("_override_samples", F.lit(0)))
        .otherwise(F.coalesce("s.conditioned_override_total", F.lit(0)))
        .alias("conditioned_override_total"),
        "total_input_tokens",
        "total_output_tokens",
        ratio(F.col("total_input_tokens"), F.col("_samples")).alias("avg_input_tokens_per_riddle"),
        ratio(F.col("total_output_tokens"), F.col("_samples")).alias(
            "avg_output_tokens_per_riddle"
        ),
        F.coalesce("avg_samples_per_riddle", F.lit(0.0)).alias("avg_samples_per_riddle"),
        F.coalesce("unique_altered_riddles", F.lit(0)).alias("unique_altered_riddles"),
        F.coalesce("conditioned_unique_altered_riddles", F.lit(0)).alias(
            "conditioned_unique_altered_riddles"
        ),
        F.col("altered_total").alias("_altered_total"),
    )


def items_by_type(entries: DataFrame) -> DataFrame:
    """Number of typed items per type, the last entry per id deciding."""
    return (
        last_wins(entries.select("id", "ord", "type"), ["id"])
        .where(F.coalesce("type", F.lit("")) != "")
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n_riddles"))
    )


def type_run_stats(per_riddle: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean accuracy and conditioned override per (type, run), NULL where nothing counts.

    Every pair of a known type and a run is present.
    """
    types = last_wins(entries.select("id", "ord", "type"), ["id"]).where(
        F.coalesce("type", F.lit("")) != ""
    )
    cells = (
        per_riddle.join(types.select(F.col("id").alias("riddle_id"), "type"), "riddle_id")
        .groupBy("run_id", "type")
        .agg(
            steady_mean(F.when(F.col("original_solved"), F.col("override_mean"))).alias("_cor"),
            steady_mean(F.col("accuracy_mean")).alias("_acc"),
        )
    )
    # Both sides of the grid are tiny: one row per type and one per run.
    all_types = types.select("type").distinct().withColumn("_const", F.lit(1))
    grid = runs.withColumn("_const", F.lit(1)).join(all_types, "_const").drop("_const")
    return grid.join(cells, ["run_id", "type"], "left").select(
        "type",
        *runs.columns,
        round4("_cor").alias("cor"),
        round4("_acc").alias("alt_acc"),
    )


def type_order(c: str = "type") -> Column:
    """1-based report position of a type, 0 for an unknown one."""
    return F.array_position(F.array(*[F.lit(t) for t in ALTERATION_TYPES]), F.col(c))


def type_rollup(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean of the rounded cells per known type, in report order."""
    return (
        cells.where(type_order() > 0)
        .groupBy("type")
        .agg(
            round4(steady_mean(F.col("cor"))).alias("mean_cor"),
            round4(steady_mean(F.col("alt_acc"))).alias("mean_alt_acc"),
        )
        .join(counts, "type")
        .orderBy(type_order())
        .select("type", "mean_cor", "mean_alt_acc", "n_riddles")
    )


def sanity_solver_accuracy(results: DataFrame) -> DataFrame:
    """Correct, total and rounded accuracy per solver. ``results``: solver, riddle_idx, correct."""
    return results.groupBy("solver").agg(
        F.sum(flag("correct")).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        round4(ratio(F.sum(flag("correct")), F.count(F.lit(1)))).alias("accuracy"),
    )


def sanity_macro_accuracy(solvers: DataFrame) -> DataFrame:
    """Mean over solvers of the rounded accuracies."""
    return solvers.agg(round4(steady_mean(F.col("accuracy"))).alias("mean_accuracy"))


def sanity_item_accuracy(results: DataFrame) -> DataFrame:
    """Mean accuracy per source item over the solvers that answered it.

    ``models_correct`` lists solvers in load order; its size is bounded by their number.
    """
    right = F.when(F.col("correct"), F.struct("solver_ord", "solver"))
    return results.groupBy("riddle_idx").agg(
        round4(ratio(F.sum(flag("correct")), F.count(F.lit(1)))).alias("mean_accuracy"),
        F.count(F.lit(1)).alias("models_evaluated"),
        F.transform(F.array_sort(F.collect_list(right)), lambda s: s["solver"]).alias(
            "models_correct"
        ),
    )


def hardest(items: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` items with the lowest mean accuracy, earlier ones first on ties."""
    return items.orderBy("mean_accuracy", "riddle_idx").limit(n)


def common_count(items: DataFrame, min_accuracy: float = 0.6) -> DataFrame:
    return items.agg(F.count_if(F.col("mean_accuracy") >= min_accuracy).alias("common"))
