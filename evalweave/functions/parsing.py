"""Reading JSON that models wrote: fences, odd types, missing members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.text import _col, strip

# Closes the strictness probe of ``strict_json``; any text that answers would not hold.
_END = "\\u0001end of text"

# The members that a generated item must have.
REQUIRED_ITEM_FIELDS = (
    "original_riddle",
    "original_answer",
    "original_reasoning",
    "altered_riddle",
    "altered_answer",
    "altered_reasoning",
    "type",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Python-level reuse of a column repeats its whole expression; with JSON parsing inside
    that makes generated code too large to compile.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_fences(c: Column | str) -> Column:
    """Text without an enclosing Markdown code fence."""
    opened = F.regexp_replace(strip(c), r"(?U)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(opened, r"(?U)\s*```$", ""))


def strict_json(c: Column | str) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, otherwise NULL.

    ``try_parse_json`` alone ignores what follows the first value. Closing the text in an
    array with a marker as last element shows whether the value is the whole text.
    """
    wrapped = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit(f',"{_END}"]'))), "$", "array<variant>"
    )
    return let(
        wrapped,
        lambda w: F.when(
            (F.size(w) == 2)
            & (F.to_json(F.try_element_at(w, F.lit(2))) == F.lit(f'"{_END}"')),
            F.try_element_at(w, F.lit(1)),
        ),
    )


def json_object(c: Column | str) -> Column:
    """As ``strict_json``, NULL for anything but an object."""
    c = _col(c)
    return F.when(strip(c).startswith("{"), strict_json(c))


def json_array(c: Column | str) -> Column:
    """ARRAY<VARIANT> of a JSON list; for an object, its first member that is a list."""
    def first_list(text: Column, value: Column) -> Column:
        return let(
            F.try_variant_get(value, "$", "map<string,variant>"),
            lambda members: F.try_element_at(
                members,
                F.try_element_at(
                    F.filter(
                        F.json_object_keys(text),
                        lambda k: F.to_json(F.try_element_at(members, k)).startswith("["),
                    ),
                    F.lit(1),
                ),
            ),
        )

    def read(text: Column) -> Column:
        return let(
            strict_json(text),
            lambda value: F.try_variant_get(
                F.when(text.startswith("["), value).when(
                    text.startswith("{"), first_list(text, value)
                ),
                "$",
                "array<variant>",
            ),
        )

    return let(strip(c), read)


def member_text(obj: Column, name: str, default: str | None = None) -> Column:
    """A member as text; a scalar is written as Python's ``str`` writes it."""
    def shown(raw: Column) -> Column:
        return (
            F.when(raw.isNull(), F.lit(default))
            .when(raw == "true", F.lit("True"))
            .when(raw == "false", F.lit("False"))
            .when(raw == "null", F.lit("None"))
            .otherwise(F.try_variant_get(obj, f"$.{name}", "string"))
        )

    return let(F.to_json(F.try_variant_get(obj, f"$.{name}", "variant")), shown)


def json_truthy(raw: Column) -> Column:
    """Truth of a JSON text: false for an absent value, null, false, zero and anything empty."""
    def truth(r: Column) -> Column:
        empty = r.isin("null", "false", '""', "[]", "{}")
        zero = F.coalesce(r.try_cast("double") == 0, F.lit(False))
        return F.coalesce(~empty & ~zero, F.lit(False))

    return let(raw, truth)


def member_true(obj: Column, name: str) -> Column:
    return json_truthy(F.to_json(F.try_variant_get(obj, f"$.{name}", "variant")))


def member_list(obj: Column, name: str) -> Column:
    """A member as ARRAY<STRING>, NULL when it is absent or not a list."""
    return F.try_variant_get(obj, f"$.{name}", "array<string>")


def parsed_answer(raw: Column | str, keep: int = 500) -> Column:
    """Struct (answer, reasoning) of a model's reply.

    A reply that is not a JSON object is the answer itself, cut to ``keep`` characters as
    the data model asks.
    """
    def read(obj: Column) -> Column:
        return F.struct(
            F.when(obj.isNotNull(), strip(member_text(obj, "answer", "")))
            .otherwise(F.left(strip(raw), F.lit(keep)))
            .alias("answer"),
            F.when(obj.isNotNull(), strip(member_text(obj, "reasoning", "")))
            .otherwise(F.lit(""))
            .alias("reasoning"),
        )

    return let(json_object(strip_fences(raw)), read)


def parsed_sanity_answer(raw: Column | str) -> Column:
    return parsed_answer(raw, keep=200)["answer"]


def parsed_judgment(raw: Column | str) -> Column:
    """Struct (correct, gave_original, competing); all false when unreadable."""
    return let(
        json_object(strip_fences(raw)),
        lambda obj: F.struct(
            member_true(obj, "correct").alias("correct"),
            member_true(obj, "gave_original").alias("gave_original"),
            member_true(obj, "competing").alias("competing"),
        ),
    )


def parsed_sanity_judgment(raw: Column | str) -> Column:
    return let(
        json_object(strip_fences(raw)),
        lambda obj: F.struct(member_true(obj, "correct").alias("correct")),
    )


def has_required_fields(item: Column) -> Column:
    """True when every required member is present and truthy."""
    ok = F.lit(True)
    for name in REQUIRED_ITEM_FIELDS:
        ok = ok & member_true(item, name)
    return ok
