"""Prefix join: the first entry, in declared order, whose prefix a key starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.ordering import with_constants


def first_prefix(items: DataFrame, key: str, prefixes: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the value of the first of ``prefixes`` that starts ``key``, else NULL.

    ``prefixes`` has prefix STRING, value STRING and ord BIGINT, the declared order; equal
    ``ord`` go by prefix, then value. Each distinct key is cut to the lengths that prefixes have,
    so the match is an equi-join and neither side has to fit into memory; a key gives at
    most as many rows as there are lengths. The empty prefix fits every key; a NULL key or
    prefix fits nothing.
    """
    table = prefixes.where("prefix IS NOT NULL").select(
        F.col("prefix").alias("_cut"), F.struct("ord", "prefix", "value").alias("_entry")
    )
    lengths = table.agg(F.collect_set(F.length("_cut")).alias("_lengths"))
    keys = items.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    cuts = with_constants(keys, lengths).select(
        "_key",
        F.explode(F.expr("filter(_lengths, n -> n <= length(_key))")).alias("_n"),
    )
    cuts = cuts.withColumn("_cut", F.expr("substring(_key, 1, _n)"))
    best = cuts.join(table, "_cut").groupBy("_key").agg(F.min("_entry").alias("_entry"))
    found = best.select("_key", F.col("_entry.value").alias("_value"))
    kept = [F.col(f"`{c}`") for c in items.columns if c != name]
    return items.join(found, F.col(key) == F.col("_key"), "left").select(
        *kept, F.col("_value").alias(name)
    )
