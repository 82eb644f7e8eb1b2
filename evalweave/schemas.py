"""Table schemas. ``ord`` is the ingest order and exists only in our tables."""

from __future__ import annotations


SOURCE_ITEMS = "ord BIGINT, riddle_idx BIGINT, riddle STRING, answer STRING"

SANITY_ANSWERS = (
    "riddle_idx BIGINT, riddle STRING, expected_answer STRING, model_answer STRING, solver STRING"
)

SANITY_JUDGMENTS = "riddle_idx BIGINT, judgment STRUCT<correct: BOOLEAN>"

SANITY_RESULTS = (
    "judge STRING, "
    "models ARRAY<STRUCT<solver: STRING, correct: BIGINT, total: BIGINT, accuracy: DOUBLE>>, "
    "mean_accuracy DOUBLE, "
    "per_riddle ARRAY<STRUCT<riddle_idx: BIGINT, riddle: STRING, expected_answer: STRING, "
    "mean_accuracy: DOUBLE, models_evaluated: BIGINT, models_correct: ARRAY<STRING>>>"
)

TYPE_DOCUMENT = (
    "generated_at STRING, "
    "types ARRAY<STRUCT<type: STRING, mean_cor: DOUBLE, mean_alt_acc: DOUBLE, n_riddles: BIGINT, "
    "per_model: MAP<STRING, STRUCT<model: STRING, reasoning_enabled: BOOLEAN, "
    "reasoning_effort: STRING, cor: DOUBLE, alt_acc: DOUBLE>>>>"
)

RAW = (
    "id STRING, original_riddle STRING, original_answer STRING, original_reasoning STRING, "
    "altered_riddle STRING, altered_answer STRING, altered_reasoning STRING, "
    "type STRING, source STRING"
)

QUALITY_FLAGS = (
    "answer_valid",
    "is_distinct",
    "has_competing_answers",
    "is_subtle",
    "is_logical",
    "is_clear",
    "needs_review",
)

REJECTED = (
    "original_riddle STRING, original_answer STRING, original_reasoning STRING, "
    "altered_riddle STRING, altered_answer STRING, altered_competing_answers ARRAY<STRING>, "
    "altered_reasoning STRING, source STRING, type STRING, answer_valid BOOLEAN, "
    "is_distinct BOOLEAN, has_competing_answers BOOLEAN, is_subtle BOOLEAN, is_logical BOOLEAN, "
    "is_clear BOOLEAN, needs_review BOOLEAN, review_reason STRING, validation_reasoning STRING"
)

VALIDATED = (
    "id STRING, original_accepted_answers ARRAY<STRING>, "
    "altered_accepted_answers ARRAY<STRING>, " + REJECTED
)

POOL = VALIDATED + (
    ", dedup_retained BOOLEAN, dedup_duplicate_of STRING, used_in_set BOOLEAN, used_set STRING"
)

ENTRIES = POOL + ", `set` STRING"

MODEL_OUTPUTS = (
    "riddle_id STRING, riddle_type STRING, sample_index INT, riddle_text STRING, "
    "model_answer STRING, model_reasoning STRING, raw_response STRING, model STRING, "
    "provider STRING, quantization STRING, temperature DOUBLE, reasoning_enabled BOOLEAN, "
    "reasoning_effort STRING, input_tokens BIGINT, output_tokens BIGINT, timestamp STRING"
)

JUDGMENTS = (
    "riddle_id STRING, riddle_type STRING, sample_index INT, "
    "judgment STRUCT<correct: BOOLEAN, gave_original: BOOLEAN, competing: BOOLEAN>"
)

EVAL_RESULTS = (
    "model STRING, provider STRING, quantization STRING, reasoning_enabled BOOLEAN, "
    "reasoning_effort STRING, "
    "summary STRUCT<original_total: BIGINT, original_correct: BIGINT, original_accuracy: DOUBLE, "
    "altered_total: BIGINT, altered_correct: BIGINT, altered_accuracy: DOUBLE, "
    "pattern_override_rate: DOUBLE, conditioned_override_total: BIGINT, "
    "conditioned_override_count: BIGINT, conditioned_override_rate: DOUBLE, "
    "total_input_tokens: BIGINT, total_output_tokens: BIGINT>, "
    "details ARRAY<STRUCT<riddle_id: STRING, riddle_type: STRING, sample_index: INT, "
    "model_answer: STRING, correct: BOOLEAN, gave_original_answer: BOOLEAN, "
    "original_answer: STRING>>"
)

# The public columns of a released item.
RELEASE_COLUMNS = (
    "id",
    "original_riddle",
    "original_answer",
    "original_accepted_answers",
    "original_reasoning",
    "altered_riddle",
    "altered_answer",
    "altered_accepted_answers",
    "altered_competing_answers",
    "altered_reasoning",
    "type",
    "source",
)

# The alteration types in report order.
ALTERATION_TYPES = ("constraint_addition", "meaning_shift", "context_swap", "bias_probe")
