"""Routing generated items by the validator's verdict, and by human decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evalweave.functions.answers import comma_list
from evalweave.functions.text import strip
from evalweave.operators.ordering import last_wins, union_in_order, with_sequential_id
from evalweave.operators.quality import (
    is_flagged,
    is_retained,
    rejected_record,
    validated_record,
    with_validation,
)
from evalweave.operators.resume import content_digest, without_content


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows as ``base``, where new ids continue."""
    return df.agg(F.count(F.lit(1)).alias("base"))


def pending_validation(raw: DataFrame, validated: DataFrame, rejected: DataFrame) -> DataFrame:
    return without_content(raw, validated, rejected)


def route_validated(
    raw: DataFrame,
    responses: DataFrame,
    validated: DataFrame,
    rejected: DataFrame,
    observations: tuple[Observation, Observation] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(newly validated, newly rejected) rows.

    ``responses`` holds ord, text and error of the pending rows. A failed or unreadable
    reply is recorded nowhere, so its row is pending again next time. ``observations`` receive
    ``passed`` and ``failed`` when the two tables are stored.
    """
    pending = pending_validation(raw, validated, rejected)
    replies = responses.where(F.col("error").isNull()).select("ord", "text")
    checked = with_validation(pending.join(replies, "ord"))
    passed = validated_record(checked.where("v_overall_valid"))
    failed = rejected_record(checked.where("NOT v_overall_valid"))
    numbered = with_sequential_id(passed, "val_", row_count(validated))
    if observations is not None:
        numbered = numbered.observe(observations[0], F.count(F.lit(1)).alias("passed"))
        failed = failed.observe(observations[1], F.count(F.lit(1)).alias("failed"))
    return numbered, failed


def review_candidates(
    validated: DataFrame, pool: DataFrame, human_rejected: DataFrame
) -> DataFrame:
    """Retained items that no one has decided on."""
    return without_content(validated.where(is_retained()), pool, human_rejected)


def review_route(
    validated: DataFrame, pool: DataFrame, human_rejected: DataFrame, decisions: DataFrame
) -> dict[str, DataFrame]:
    """Tables ``pool`` and ``rejected`` to append, and ``pending`` items.

    Items without a review flag go to the pool; flagged ones follow the last decision on
    their content: approve, edit and confirm, or reject. Skipped and undecided items stay
    pending. Pool ids continue after the pool, automatic ones first.
    """
    items = review_candidates(validated, pool, human_rejected)
    decided = last_wins(
        decisions.withColumn("_digest", content_digest())
        .where(F.col("_digest").isNotNull())
        .select(
            "_digest", "ord", "action", "edited_answer", "edited_accepted", "edited_competing",
            "confirmed",
        ),
        ["_digest"],
    ).drop("ord")
    flagged = (
        items.where(is_flagged())
        .withColumn("_digest", content_digest())
        .join(decided, "_digest", "left")
        .drop("_digest")
    )
    edit = F.col("action") == "e"

    def edited_list(column: str) -> Column:
        return F.when(edit & (strip(F.coalesce(column, F.lit(""))) != ""), comma_list(column))

    edited = flagged.withColumns(
        {
            "altered_answer": F.coalesce(
                F.when(edit, F.nullif(strip("edited_answer"), F.lit(""))), "altered_answer"
            ),
            "altered_accepted_answers": F.coalesce(
                edited_list("edited_accepted"), "altered_accepted_answers"
            ),
            "altered_competing_answers": F.coalesce(
                edited_list("edited_competing"), "altered_competing_answers"
            ),
        }
    )
    confirmed = F.coalesce("confirmed", F.lit(False))
    approve = (F.col("action") == "a") | (edit & confirmed)
    reject = (F.col("action") == "r") | (edit & ~confirmed)
    yes = F.coalesce(approve, F.lit(False))
    no = F.coalesce(reject, F.lit(False))
    columns = items.columns
    to_pool = union_in_order(
        items.where(~is_flagged()), edited.where(yes).select(*columns)
    )
    return {
        "pool": with_sequential_id(to_pool, "pool_", row_count(pool)),
        "rejected": edited.where(no).select(*columns),
        "pending": flagged.where(~yes & ~no).select(*columns),
    }
