"""Sanity check of source items: which ones do solvers know?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators import metrics
from evalweave.operators.ordering import first_wins, last_wins, with_constants
from evalweave.operators.resume import common_items


def judged_answers(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    """(solver, solver_ord, riddle_idx, correct): one verdict per solver and item.

    The last judgment of a key counts; an unjudged or empty answer is wrong. A solver label
    that occurs in a later file replaces the earlier file.
    """
    latest = answers.groupBy("solver").agg(
        F.max("solver_ord").alias("_load"), F.min("solver_ord").alias("_first")
    )
    kept = answers.join(latest, "solver").where("solver_ord = _load")
    asked = kept.groupBy("solver", "riddle_idx").agg(F.min("_first").alias("solver_ord"))
    verdicts = last_wins(
        judgments.select("solver", "riddle_idx", "ord", "judgment"), ["solver", "riddle_idx"]
    ).select("solver", "riddle_idx", F.col("judgment.correct").alias("correct"))
    return asked.join(verdicts, ["solver", "riddle_idx"], "left").select(
        "solver",
        "solver_ord",
        "riddle_idx",
        F.coalesce("correct", F.lit(False)).alias("correct"),
    )


def item_metadata(answers: DataFrame) -> DataFrame:
    """(riddle_idx, riddle, expected_answer) of the first answer per item."""
    return first_wins(
        answers.select("riddle_idx", "ord", "riddle", "expected_answer"), ["riddle_idx"]
    ).drop("ord")


def sanity_items(answers: DataFrame, judgments: DataFrame) -> DataFrame:
    results = judged_answers(answers, judgments)
    return item_metadata(answers).join(metrics.sanity_item_accuracy(results), "riddle_idx")


def sanity_documents(report: dict[str, DataFrame], max_items: int = 100_000) -> DataFrame:
    """The report as documents: judge, models in order of their names, mean accuracy and items.

    Each document holds ``max_items`` numbers of items at most and repeats the (few) models; column
    ``part`` tells them apart. Small checks are one document. ``write_documents`` stores
    them, and ``scan_sanity_results`` reads the items of one document or a folder of them.
    Without items there is no document.
    """
    item = F.struct(
        "riddle_idx", "riddle", "expected_answer", "mean_accuracy", "models_evaluated", "models_correct"
    )
    part = F.floor(F.col("riddle_idx") / max_items).cast("long").alias("part")
    blocks = report["items"].groupBy(part).agg(F.array_sort(F.collect_list(item)).alias("per_riddle"))
    models = report["solvers"].agg(
        F.array_sort(F.collect_list(F.struct("solver", "correct", "total", "accuracy"))).alias("models")
    )
    head = with_constants(models, report["overall"].select("judge", "mean_accuracy"))
    return with_constants(blocks, head).select("part", "judge", "models", "mean_accuracy", "per_riddle")


def sanity_report(
    answers: DataFrame, judgments: DataFrame, judge: str = ""
) -> dict[str, DataFrame]:
    """Tables ``solvers``, ``overall``, ``items``, ``hardest`` and ``common`` of the check."""
    solvers = metrics.sanity_solver_accuracy(judged_answers(answers, judgments))
    items = sanity_items(answers, judgments)
    overall = metrics.sanity_macro_accuracy(solvers).select(
        F.lit(judge).alias("judge"), "mean_accuracy"
    )
    return {
        "solvers": solvers,
        "overall": with_constants(overall, metrics.common_count(items)),
        "items": items,
        "hardest": metrics.hardest(items),
        "common": common_items(items),
    }
