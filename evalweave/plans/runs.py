"""From entries to tasks, from replies to model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.ordering import first_wins, global_rank
from evalweave.operators.quality import only_variant, output_record, with_text
from evalweave.operators.resume import pending_tasks


def effective_samples(num_samples: Column | int, temperature: Column | float) -> Column:
    """Several samples are pointless at temperature zero."""
    n = F.lit(num_samples) if isinstance(num_samples, int) else num_samples
    t = F.lit(temperature) if isinstance(temperature, float | int) else temperature
    return F.when(t == 0, F.least(n, F.lit(1))).otherwise(n).cast("int")


def first_originals(entries: DataFrame) -> DataFrame:
    """The first entry of every distinct non-empty original text."""
    return first_wins(
        entries.where(F.coalesce("original_riddle", F.lit("")) != "").select(
            "original_riddle", "ord", "id"
        ),
        ["original_riddle"],
    )


def build_tasks(
    entries: DataFrame,
    only: str = "both",
    num_samples: int = 1,
    temperature: float = 0.0,
    done: DataFrame | None = None,
) -> DataFrame:
    """(ord, riddle_id, riddle_type, sample_index, riddle_text) still to run.

    Each original text is asked once, under its first entry; an altered text once per
    sample. ``ord`` follows entry, variant (original first) and sample.
    """
    asked = first_originals(entries).select("ord", F.lit(True).alias("_ask"))
    base = entries.select("ord", "id", "original_riddle", "altered_riddle").join(
        asked, "ord", "left"
    )
    n = effective_samples(num_samples, temperature)
    original = F.when(
        F.col("_ask"),
        F.array(
            F.struct(
                F.lit("original").alias("riddle_type"),
                F.lit(1).alias("sample_index"),
                F.coalesce("original_riddle", F.lit("")).alias("riddle_text"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<riddle_type:string,sample_index:int,riddle_text:string>>"))
    altered = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.lit("altered").alias("riddle_type"),
            i.cast("int").alias("sample_index"),
            F.coalesce("altered_riddle", F.lit("")).alias("riddle_text"),
        ),
    )
    tasks = base.select(
        F.col("ord").alias("_entry_ord"),
        F.coalesce("id", F.lit("unknown")).alias("riddle_id"),
        F.posexplode(F.concat(original, altered)).alias("_pos", "_t"),
    )
    tasks = global_rank(tasks, "_entry_ord", tiebreak=["_pos"], name="ord", start=0)
    tasks = tasks.select("ord", "riddle_id", "_t.*")
    tasks = with_text(only_variant(tasks, only))
    return tasks if done is None else pending_tasks(tasks, done)


def first_runnable(tasks: DataFrame) -> DataFrame:
    """The first task with text, for a smoke test."""
    return with_text(tasks).orderBy("ord").limit(1)


def ingest_outputs(responses: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Model outputs of raw replies, with ``run_id`` and ``ord`` where the replies have them."""
    extra = [c for c in ("run_id", "ord") if c in responses.columns]
    return output_record(responses, timestamp, extra)
