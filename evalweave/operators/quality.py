"""Row predicates, routing and projections of the curation stages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.answers import accepted_answers, competing_answers, single_answer
from evalweave.functions.parsing import (
    json_object,
    member_list,
    member_text,
    member_true,
    parsed_answer,
    strip_fences,
)
from evalweave.functions.text import fixed_digits, percent, plus_minus, record_time
from evalweave.schemas import QUALITY_FLAGS, RELEASE_COLUMNS


def release_columns(entries: DataFrame) -> DataFrame:
    """The public columns, in the order the table has them; absent ones stay absent."""
    return entries.select(*[c for c in entries.columns if c in RELEASE_COLUMNS])


def is_used(c: str = "used_in_set") -> Column:
    return F.coalesce(c, F.lit(False))


def pending_pool(pool: DataFrame) -> DataFrame:
    return pool.where(~is_used())


def used_pool(pool: DataFrame) -> DataFrame:
    return pool.where(is_used())


def is_retained(c: str = "dedup_retained") -> Column:
    """Not marked as a duplicate; a missing mark counts as retained."""
    return ~F.col(c).eqNullSafe(F.lit(False))


def is_flagged(c: str = "needs_review") -> Column:
    """Needs a human; a missing flag does not."""
    return F.col(c).eqNullSafe(F.lit(True))


def split_empty_answers(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to judge, already judged false because the answer is empty)."""
    empty = F.coalesce("model_answer", F.lit("")) == ""
    judged = pending.where(empty).withColumn(
        "judgment", F.struct(F.lit(False).alias("correct"))
    )
    return pending.where(~empty), judged


def only_variant(tasks: DataFrame, only: str = "both") -> DataFrame:
    """Keep original, altered or both variants."""
    if only not in ("both", "original", "altered"):
        raise ValueError(f"only must be both, original or altered, not {only!r}")
    wanted = ["original", "altered"] if only == "both" else [only]
    return tasks.where(F.col("riddle_type").isin(wanted))


def with_text(tasks: DataFrame, column: str = "riddle_text") -> DataFrame:
    """Drop tasks without prompt text."""
    return tasks.where(F.coalesce(column, F.lit("")) != "")


def metadata_kinds(outputs: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """The distinct metadata of each run with its first ``ord`` and the totals of ``sums``.

    ``run_metadata`` gives the same for these rows as for the outputs, and so do sums per run, so
    large outputs are read once for both.
    """
    return outputs.groupBy(
        "run_id", "model", "provider", "quantization", "reasoning_enabled", "reasoning_effort"
    ).agg(F.min("ord").alias("ord"), *[F.sum(c).alias(c) for c in sums])


def run_metadata(outputs: DataFrame) -> DataFrame:
    """One row per run: first model, provider, quantisation; reasoning setting; its conflicts.

    ``settings`` counts the distinct (flag, effort) pairs of the run, the effort being
    ignored where reasoning is off. More than one means that the run mixes settings.
    """
    flag = F.coalesce("reasoning_enabled", F.lit(False))
    setting = F.struct(
        flag.alias("enabled"), F.coalesce(F.when(flag, F.col("reasoning_effort")), F.lit("\0"))
    )
    named = F.when(F.coalesce("model", F.lit("unknown")) != "", F.col("ord"))
    # Texts are grouping keys here, not aggregates, so the large step hashes; what remains is
    # one row per distinct combination.
    return metadata_kinds(outputs).groupBy("run_id").agg(
        F.coalesce(F.min_by("model", named), F.lit("unknown")).alias("model"),
        F.coalesce(F.min_by("provider", named), F.lit("")).alias("provider"),
        F.coalesce(F.min_by("quantization", named), F.lit("")).alias("quantization"),
        F.min_by(flag, "ord").alias("reasoning_enabled"),
        F.min_by(F.when(flag, F.col("reasoning_effort")), "ord").alias("reasoning_effort"),
        # Every pair lies between the extremes; equal extremes mean a single pair.
        F.when(F.min(setting) == F.max(setting), F.lit(1)).otherwise(F.lit(2)).alias("_mixed"),
        F.min("ord").alias("run_ord"),
    )


def checked_run_metadata(outputs: DataFrame) -> DataFrame:
    """As ``run_metadata``, failing at run time when a run mixes reasoning settings."""
    meta = run_metadata(outputs)
    message = F.concat(F.lit("Inconsistent reasoning settings in run "), F.col("run_id"))
    checked = F.when(F.col("_mixed") > 1, F.raise_error(message)).otherwise(F.col("run_id"))
    return meta.withColumn("run_id", checked.cast("string")).drop("_mixed")


def with_validation(items: DataFrame, raw: str = "text") -> DataFrame:
    """Read the validator's reply; rows whose reply is no JSON object drop out.

    Those rows are recorded nowhere, so the next run validates them again.
    """
    read = items.withColumn("_v", json_object(strip_fences(raw))).where(F.col("_v").isNotNull())
    v = F.col("_v")
    flags = {f"v_{name}": member_true(v, name) for name in QUALITY_FLAGS}
    return read.withColumns(
        {
            **flags,
            "v_overall_valid": member_true(v, "overall_valid"),
            "v_accepted": member_list(v, "altered_accepted_answers"),
            "v_competing": member_list(v, "competing_answers"),
            "v_review_reason": member_text(v, "review_reason", ""),
            "v_reasoning": member_text(v, "reasoning", ""),
        }
    ).drop("_v")


def validity_agrees() -> Column:
    """Whether the overall verdict equals the rule valid, distinct and logical."""
    rule = F.col("v_answer_valid") & F.col("v_is_distinct") & F.col("v_is_logical")
    return F.col("v_overall_valid") == rule


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(name, F.lit(default)).alias(name)


def _quality_columns() -> list[Column]:
    return [
        *[F.col(f"v_{name}").alias(name) for name in QUALITY_FLAGS],
        F.col("v_review_reason").alias("review_reason"),
        F.col("v_reasoning").alias("validation_reasoning"),
    ]


def rejected_record(checked: DataFrame) -> DataFrame:
    return checked.select(
        "ord",
        _text("original_riddle"),
        _text("original_answer"),
        _text("original_reasoning"),
        _text("altered_riddle"),
        _text("altered_answer"),
        competing_answers("v_competing", "original_answer").alias("altered_competing_answers"),
        _text("altered_reasoning"),
        _text("source"),
        _text("type", "constraint_addition"),
        *_quality_columns(),
    )


def validated_record(checked: DataFrame) -> DataFrame:
    """The validated projection; ids are assigned by the caller."""
    return checked.select(
        "ord",
        single_answer(F.coalesce("original_answer", F.lit(""))).alias("original_accepted_answers"),
        accepted_answers("altered_answer", "v_accepted").alias("altered_accepted_answers"),
        _text("original_riddle"),
        _text("original_answer"),
        _text("original_reasoning"),
        _text("altered_riddle"),
        _text("altered_answer"),
        competing_answers("v_competing", "original_answer").alias("altered_competing_answers"),
        _text("altered_reasoning"),
        _text("source"),
        _text("type", "constraint_addition"),
        *_quality_columns(),
    )


def output_record(
    responses: DataFrame, timestamp: Column | None = None, extra: Iterable[str] = ()
) -> DataFrame:
    """Model-output rows from raw replies.

    A failed call becomes the answer ``ERROR`` with the message as reasoning; an empty body
    becomes ``ERROR`` with ``Empty response``. Either way the row is recorded, and no task
    fails.
    """
    failed = F.col("error").isNotNull()
    body = F.coalesce("raw_response", F.lit(""))
    parsed = F.col("_parsed")
    return responses.withColumn("_parsed", parsed_answer(body)).select(
        *extra,
        "riddle_id",
        "riddle_type",
        "sample_index",
        "riddle_text",
        F.when(failed | (body == ""), F.lit("ERROR"))
        .otherwise(parsed["answer"])
        .alias("model_answer"),
        F.when(failed, F.col("error"))
        .when(body == "", F.lit("Empty response"))
        .otherwise(parsed["reasoning"])
        .alias("model_reasoning"),
        F.when(failed, F.lit("")).otherwise(body).alias("raw_response"),
        F.lower("model").alias("model"),
        "provider",
        "quantization",
        "temperature",
        "reasoning_enabled",
        "reasoning_effort",
        F.when(~failed, F.col("input_tokens")).alias("input_tokens"),
        F.when(~failed, F.col("output_tokens")).alias("output_tokens"),
        record_time(timestamp).alias("timestamp"),
    )


def display_columns(board: DataFrame) -> DataFrame:
    """Text columns of a leaderboard for people."""
    return board.select(
        "rank",
        F.format_string("[%d–%d]", F.col("rank_best"), F.col("rank_worst")).alias("rank_spread"),
        "model",
        F.when(F.col("reasoning_enabled"), "on").otherwise("off").alias("reasoning"),
        F.coalesce(F.nullif("reasoning_effort", F.lit("")), F.lit("-")).alias("effort"),
        percent("original_accuracy").alias("original_accuracy"),
        percent("altered_accuracy").alias("altered_accuracy"),
        percent("conditioned_override_rate").alias("conditioned_override"),
        plus_minus(F.coalesce("conditioned_override_ci95", F.lit(0.0))).alias("ci95"),
        percent("pattern_override_rate").alias("override_rate"),
        F.format_string(
            "%.1f", fixed_digits(F.coalesce("avg_output_tokens_per_riddle", F.lit(0.0)), 1)
        ).alias("tokens_per_riddle"),
        F.format_string(
            "%.2f", fixed_digits(F.coalesce("avg_samples_per_riddle", F.lit(0.0)), 2)
        ).alias("samples_per_riddle"),
    )
