"""Evaluating all runs at once, and ranking them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.answers import judge_targets
from evalweave.functions.prompts import as_json, render
from evalweave.functions.text import model_key, report_time
from evalweave.operators import bootstrap, metrics
from evalweave.operators.coverage import complete_runs
from evalweave.operators.ordering import global_rank, last_wins
from evalweave.operators.quality import checked_run_metadata, metadata_kinds
from evalweave.operators.resume import pending_judgments, with_entries, with_judgments
from evalweave.session import materialise
from evalweave.sources.documents import evaluation_details

_SUMMARY = (
    "original_total",
    "original_correct",
    "original_accuracy",
    "altered_total",
    "altered_correct",
    "altered_accuracy",
    "pattern_override_rate",
    "conditioned_override_total",
    "conditioned_override_count",
    "conditioned_override_rate",
    "total_input_tokens",
    "total_output_tokens",
)
_RATES = {
    "original_accuracy",
    "altered_accuracy",
    "pattern_override_rate",
    "conditioned_override_rate",
}


@dataclass
class Evaluation:
    """``summary``: one row per run. ``details``: one row per judged sample.

    ``items`` are the ``metrics.item_sums`` of the details, stored once for all metrics.
    """

    summary: DataFrame
    details: DataFrame
    items: DataFrame

    def documents(self, max_samples: int = 100_000) -> DataFrame:
        """One nested document per run, for export.

        A run with more than ``max_samples`` samples is spread over several documents that
        repeat its summary, so no row grows with the run. ``evaluation_from_documents`` puts
        the parts together again.
        """
        placed = global_rank(self.details, "ord", by=["run_id"], name="_n", start=0)
        sample = F.struct(
            "ord", "riddle_id", "riddle_type", "sample_index", "model_answer",
            "correct", "gave_original_answer", "original_answer",
        ).alias("_s")
        samples = placed.where("run_id IS NOT NULL").select(
            "run_id", F.floor(F.col("_n") / max_samples).alias("part"), sample
        )
        # Every run has a first part, samples or not, so the few summaries can be sent to the
        # parts. The other way round, one task would hold all parts of a run.
        first = self.summary.select(
            "run_id", F.lit(0).cast("long").alias("part"),
            F.lit(None).cast(samples.schema["_s"].dataType).alias("_s"),
        )
        parts = samples.union(first).groupBy(F.col("run_id").alias("_run"), "part").agg(
            F.array_sort(F.collect_list("_s")).alias("_d")
        )
        details = F.transform("_d", lambda d: d.dropFields("ord"))
        return parts.join(F.broadcast(self.summary), F.col("_run").eqNullSafe(F.col("run_id"))).select(
            "run_id", "part", "model", "provider",
            "quantization", "reasoning_enabled", "reasoning_effort",
            F.struct(*_SUMMARY).alias("summary"),
            F.when(F.size("_d") > 0, details).alias("details"),
        )


def judge_prompts(
    outputs: DataFrame, judgments: DataFrame, entries: DataFrame, template: str
) -> DataFrame:
    """Outputs still to judge with their ``prompt``; unknown items are left out.

    The template may use {riddle}, {model_answer}, {accepted}, {original}, {competing}.
    """
    pending = with_entries(
        pending_judgments(outputs, judgments),
        entries,
        [
            "original_answer", "altered_answer", "original_accepted_answers",
            "altered_accepted_answers", "altered_competing_answers",
        ],
    )
    values = {
        "riddle": F.coalesce("riddle_text", F.lit("")),
        "model_answer": F.coalesce("model_answer", F.lit("")),
        "accepted": as_json(judge_targets("riddle_type")),
        "original": as_json(judge_targets(F.lit("original"))),
        "competing": as_json("altered_competing_answers"),
    }
    return pending.select(
        "run_id", "ord", "riddle_id", "riddle_type", "sample_index",
        render(template, **values).alias("prompt"),
    )


def evaluate_runs(outputs: DataFrame, judgments: DataFrame, entries: DataFrame) -> Evaluation:
    """Summary and details of every run.

    Every output row is a sample, repeated keys included. Token totals cover all outputs;
    the other numbers only items that are in ``entries``. Writes the sums per item, and the
    kinds of metadata of each run, to the scratch folder.
    """
    judged = with_judgments(
        with_entries(outputs, entries, ["original_answer"]), judgments
    )
    details = metrics.detail_rows(judged)
    # The sums need no text of an entry, so unknown items leave after the sums, not sample by sample.
    sums = metrics.item_sums(
        metrics.detail_rows(
            with_judgments(outputs, judgments).withColumn("original_answer", F.lit(""))
        )
    )
    items = materialise(with_entries(sums, entries, []).select(*sums.columns), "items")
    kinds = materialise(metadata_kinds(outputs, ["input_tokens", "output_tokens"]), "run_kinds")
    summary = (
        checked_run_metadata(kinds)
        .join(metrics.token_totals(kinds), "run_id")
        .join(metrics.items_summary(items), "run_id", "left")
    )
    filled = {
        c: F.coalesce(c, F.lit(0.0) if c in _RATES else F.lit(0).cast("long")) for c in _SUMMARY
    }
    return Evaluation(summary.withColumns(filled), details, items)


def evaluation_from_documents(docs: DataFrame) -> Evaluation:
    """The evaluation of runs read by ``scan_evaluations``.

    Documents with the same run id are parts of one run: the first one's summary counts, and
    the samples follow each other in part order. Missing texts are empty, missing flags
    false and missing numbers 0. Writes the sums per item to the scratch folder.
    """
    text = {"model": "unknown", "provider": "", "quantization": ""}
    summary = docs.where("part_ord = 1").select(
        "run_id", "run_ord",
        *[F.coalesce(c, F.lit(v)).alias(c) for c, v in text.items()],
        F.coalesce("reasoning_enabled", F.lit(False)).alias("reasoning_enabled"),
        "reasoning_effort",
        *[
            F.coalesce(f"summary.{c}", F.lit(0.0) if c in _RATES else F.lit(0).cast("long")).alias(c)
            for c in _SUMMARY
        ],
    )
    details = evaluation_details(docs).drop("run_ord")
    return Evaluation(summary, details, materialise(metrics.item_sums(details), "items"))


def distinct_samples(details: DataFrame) -> DataFrame:
    """The last row per sample key, for logs that hold repeated keys."""
    return last_wins(details, ["run_id", "riddle_id", "riddle_type", "sample_index"])


def ranked(board: DataFrame) -> DataFrame:
    """Positions 1..n by override rate, then accuracy, then load order; one row per run."""
    order = Window.orderBy(
        F.asc("conditioned_override_rate"), F.desc("altered_accuracy"), F.asc("run_ord")
    )
    return board.withColumn("rank", F.row_number().over(order))


def leaderboard(
    evaluation: Evaluation,
    entries: DataFrame,
    replicates: int = bootstrap.REPLICATES,
    seed: int = bootstrap.SEED,
    condition_on: str = "riddle_id",
    complete_only: bool = True,
) -> DataFrame:
    """Ranked runs with intervals and rank spread.

    Per-item statistics are written to the scratch folder once and serve the metrics, both
    intervals and all pair tests.
    """
    summary = materialise(evaluation.summary, "summary")
    items = evaluation.items
    if complete_only:
        samples = metrics.item_samples(items)
        summary = materialise(complete_runs(summary, samples, entries, unique=True), "summary")
        items = items.join(summary.select("run_id"), "run_id", "left_semi")
    per_riddle = materialise(metrics.items_stats(items, entries, condition_on), "per_riddle")
    board = materialise(ranked(metrics.board_metrics(per_riddle, summary)), "board")

    # One bootstrap pass draws for both intervals of every run.
    accuracy = per_riddle.select(
        "run_id", F.lit("accuracy").alias("metric"), "cluster",
        F.col("accuracy_mean").alias("score"),
    )
    override = per_riddle.where("original_solved").select(
        "run_id", F.lit("override").alias("metric"), "cluster",
        F.col("override_mean").alias("score"),
    )
    ci = bootstrap.clustered_ci95(
        accuracy.union(override), ["metric", "run_id"], replicates, seed
    )
    halves = ci.groupBy("run_id").agg(
        F.max(F.when(F.col("metric") == "override", F.col("ci95"))).alias("_override_ci"),
        F.max(F.when(F.col("metric") == "accuracy", F.col("ci95"))).alias("_accuracy_ci"),
    )
    spread = bootstrap.rank_spread(
        board, bootstrap.pair_signs(per_riddle, board, replicates, seed)
    )
    unseen = F.col("unique_altered_riddles") == 0
    fallback = {
        rate: bootstrap.normal_half_width(F.col(rate), F.col("_altered_total"))
        for rate in ("conditioned_override_rate", "altered_accuracy")
    }
    zero = F.lit(0.0)
    return (
        board.join(halves, "run_id", "left")
        .join(spread, "run_id")
        .withColumns(
            {
                "conditioned_override_ci95": F.when(
                    unseen, fallback["conditioned_override_rate"]
                ).otherwise(F.coalesce("_override_ci", zero)),
                "altered_accuracy_ci95": F.when(
                    unseen, fallback["altered_accuracy"]
                ).otherwise(F.coalesce("_accuracy_ci", zero)),
            }
        )
        .drop("_override_ci", "_accuracy_ci", "_altered_total", "run_ord")
        .orderBy("rank")
    )


def type_cells(evaluation: Evaluation, entries: DataFrame) -> DataFrame:
    """Type x run cells with the model key; among runs with equal keys the last one stays."""
    runs = evaluation.summary.select(
        "run_id",
        F.col("run_ord").alias("ord"),
        "model",
        "reasoning_enabled",
        "reasoning_effort",
        model_key("model", "reasoning_enabled", "reasoning_effort").alias("model_key"),
    )
    latest = last_wins(runs, ["model_key"]).drop("ord")
    per_riddle = metrics.items_stats(evaluation.items)
    return metrics.type_run_stats(per_riddle, entries, latest)


def type_stats(evaluation: Evaluation, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per type, per type and model)."""
    cells = type_cells(evaluation, entries)
    return metrics.type_rollup(cells, metrics.items_by_type(entries)), cells


def type_document(types: DataFrame, cells: DataFrame, at: Column | None = None) -> DataFrame:
    """One row (generated_at, types): known types in report order, each with a map ``per_model``.

    Small by nature: one entry per type and run. ``at`` is the time of the report, now by default.
    """
    shown = F.struct(
        "model",
        F.coalesce("reasoning_enabled", F.lit(False)).alias("reasoning_enabled"),
        "reasoning_effort",
        "cor",
        "alt_acc",
    )
    per_model = cells.groupBy("type").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("model_key", shown.alias("value"))))
        ).alias("per_model")
    )
    # A map has no order, so the array is sorted by place and type alone.
    listed = F.collect_list(
        F.struct(
            metrics.type_order().alias("place"),
            F.struct("type", "mean_cor", "mean_alt_acc", "n_riddles", "per_model").alias("type"),
        )
    )
    in_order = F.array_sort(
        listed, lambda a, b: (a["place"] - b["place"]).cast("int")
    )
    return types.join(per_model, "type").agg(
        report_time(at).alias("generated_at"),
        F.transform(in_order, lambda x: x["type"]).alias("types"),
    )
