"""Prompt texts built from columns. The wording is the caller's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column | str) -> Column:
    """``template`` with each ``{name}`` replaced by a column; lists go in as JSON.

    A slot without a value is an error, so a misspelt name cannot pass silently.
    """
    pieces: list[Column] = []
    position = 0
    for slot in _SLOT.finditer(template):
        if slot.group(1) not in values:
            raise KeyError(f"no value for {{{slot.group(1)}}}")
        value = values[slot.group(1)]
        pieces.append(F.lit(template[position : slot.start()]))
        pieces.append(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
        position = slot.end()
    pieces.append(F.lit(template[position:]))
    return F.concat(*pieces)


def as_json(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))
