"""Planning which source items to vary, and taking in what was generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evalweave.functions.parsing import (
    has_required_fields,
    json_array,
    member_text,
    strip_fences,
)
from evalweave.functions.prompts import render
from evalweave.operators.ordering import with_sequential_id
from evalweave.operators.resume import only_common
from evalweave.operators.selection import least_represented

TEXT_FIELDS = (
    "original_riddle",
    "original_answer",
    "original_reasoning",
    "altered_riddle",
    "altered_answer",
    "altered_reasoning",
    "type",
)


def plan_generation(
    source: DataFrame,
    sanity: DataFrame | None,
    raw: DataFrame,
    calls: int,
    template: str | None = None,
    min_accuracy: float = 0.6,
    seed: int = 0,
) -> DataFrame:
    """One row per call: the common source item to vary, least represented first."""
    picks = least_represented(only_common(source, sanity, min_accuracy), raw, calls, seed)
    if template is None:
        return picks
    return picks.withColumn("prompt", render(template, riddle="riddle", answer="answer"))


def generated_items(responses: DataFrame) -> DataFrame:
    """(ord, item, valid) for every element of the generated lists.

    ``responses`` holds call_idx, text and error. Failed or unreadable calls give no rows;
    ``ord`` follows the call and the place in its list, which is always below 2**31.
    """
    return (
        responses.where(F.col("error").isNull())
        .select("call_idx", F.posexplode(json_array(strip_fences("text"))).alias("_pos", "item"))
        .select(
            (F.col("call_idx") * F.lit(2**31) + F.col("_pos")).alias("ord"),
            "item",
            has_required_fields(F.col("item")).alias("valid"),
        )
    )


def ingest_generated(
    responses: DataFrame,
    raw_count: int | DataFrame,
    source: str,
    observation: Observation | None = None,
) -> DataFrame:
    """New raw rows with ids that continue after ``raw_count``; incomplete items drop out.

    ``observation`` receives generated and skipped.
    """
    items = generated_items(responses)
    if observation is not None:
        items = items.observe(
            observation,
            F.count_if("valid").alias("generated"),
            F.count_if(~F.col("valid")).alias("skipped"),
        )
    rows = items.where("valid").select(
        "ord",
        *[member_text(F.col("item"), name).alias(name) for name in TEXT_FIELDS],
        F.lit(source).alias("source"),
    )
    return with_sequential_id(rows, "raw_", raw_count)
