"""Batched calls of a caller-supplied scoring function on a prompt column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESPONSE_FIELDS = "text STRING, error STRING, input_tokens BIGINT, output_tokens BIGINT"


def score_prompts(
    prompts: DataFrame,
    fn: Callable[[str], tuple[str, int | None, int | None]],
    key_cols: Sequence[str],
    prompt_col: str = "prompt",
    max_concurrency: int = 10,
    partitions: int | None = None,
) -> DataFrame:
    """(keys, text, error, input_tokens, output_tokens), one row per prompt.

    ``fn`` maps a prompt to (text, input tokens, output tokens) and may raise; the message
    then becomes ``error`` of that row and no other row is affected. At most
    ``max_concurrency`` calls run at once in a task. The calls happen when the result is
    used: store it once before using it twice, and anti-join finished keys before it.
    """
    keys = list(key_cols)
    narrow = prompts.select(*keys, F.col(prompt_col).alias("_prompt"))
    if partitions:
        narrow = narrow.repartition(partitions)
    schema = StructType([narrow.schema[k] for k in keys])
    for field in StructType.fromDDL(RESPONSE_FIELDS).fields:
        schema = schema.add(field)

    def call(prompt: str) -> tuple:
        try:
            text, tokens_in, tokens_out = fn(prompt)
            return text, None, tokens_in, tokens_out
        except Exception as exc:  # the failure is a value of the row
            return None, str(exc), None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_concurrency) as pool:
            for frame in frames:
                answers = list(pool.map(call, frame["_prompt"]))
                out = frame[keys].copy()
                for i, field in enumerate(("text", "error")):
                    out[field] = [a[i] for a in answers]
                for i, field in enumerate(("input_tokens", "output_tokens"), 2):
                    out[field] = pd.array([a[i] for a in answers], dtype="Int64")
                yield out

    return narrow.mapInPandas(run, schema)
