"""Reproducible pseudo-random draws as plain column arithmetic.

A draw is a pure function of (seed, group, replicate, position). A retried task, another
partitioning or another engine gives the same value, which a random generator with state
cannot promise. The mixer is the published two-multiplication 32-bit finaliser of the
"hash prospector" family, evaluated in BIGINT: both constants are below 2**31, so no
product leaves the BIGINT range, and the expression stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the mixer.
MIX_A = 0x21F0AAAD
MIX_B = 0x735A2D97
MASK = 0xFFFFFFFF


def mix32(x: Column) -> Column:
    """A well-mixed 32-bit value of a BIGINT in [0, 2**32)."""
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(MIX_A)).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * F.lit(MIX_B)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 15))


def joined_keys(*keys: Column) -> Column:
    """Text keys as one text; each carries its length and NULL is a dash, so none collide."""
    parts = [
        F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in keys
    ]
    return F.concat(*parts)


def group_seed(seed: int, *keys: Column) -> Column:
    """32-bit seed of a group; one MD5 per group, not per draw."""
    text = F.concat(F.lit(f"{seed}|"), joined_keys(*keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash60(*c: Column) -> Column:
    """60-bit hash of texts, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 15), 16, 10).cast("long")


def chain(base: Column, n: Column) -> Column:
    """Fold another number into a 32-bit value."""
    return mix32((base + n).bitwiseAND(F.lit(MASK)))

