"""Column functions on lists of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.text import _col, strip, text_key


def distinct_answers(answers: Column) -> Column:
    """Distinct by text key in list order; the first spelling stays and blanks go."""
    return F.aggregate(
        answers,
        F.array().cast("array<string>"),
        lambda kept, a: F.when(
            (text_key(a) == "") | F.exists(kept, lambda k: text_key(k) == text_key(a)), kept
        ).otherwise(F.concat(kept, F.array(a))),
    )


def accepted_answers(answer: Column | str, proposed: Column | str) -> Column:
    """The answer followed by the proposed list, distinct; only the answer without a list."""
    answer, proposed = F.coalesce(_col(answer), F.lit("")), _col(proposed)
    return F.when(
        F.coalesce(F.size(proposed), F.lit(0)) > 0,
        distinct_answers(F.concat(F.array(answer), proposed)),
    ).otherwise(single_answer(answer))


def single_answer(answer: Column | str) -> Column:
    """One-element list, empty for an empty answer."""
    answer = _col(answer)
    return F.when(F.coalesce(answer, F.lit("")) != "", F.array(answer)).otherwise(
        F.array().cast("array<string>")
    )


def competing_answers(proposed: Column | str, original: Column | str) -> Column:
    """The proposed list without spellings of the original answer; repeats stay."""
    original = text_key(original)
    return F.filter(
        F.coalesce(_col(proposed), F.array().cast("array<string>")),
        lambda a: text_key(a) != original,
    )


def comma_list(c: Column | str) -> Column:
    """Trimmed, non-blank parts of a comma-separated text."""
    return F.filter(F.transform(F.split(_col(c), ","), lambda p: strip(p)), lambda p: p != "")


def judge_targets(riddle_type: Column | str) -> Column:
    """Accepted answers to judge against: those of the original or of the altered text."""
    original = F.coalesce(
        F.col("original_accepted_answers"),
        F.array(F.coalesce(F.col("original_answer"), F.lit(""))),
    )
    altered = F.coalesce(
        F.col("altered_accepted_answers"),
        F.array(F.coalesce(F.col("altered_answer"), F.lit(""))),
    )
    return F.when(_col(riddle_type) == "original", original).otherwise(altered)
