"""Removal of repeated passages by overlapping windows of three lines.

Lines are parts between line feeds that hold a word; others are never compared or removed.
Every three consecutive such lines make a window, known by its MD5. Of equal windows
anywhere in the corpus the first one (by document id, nulls first, then row and place)
stays; the lines of all later ones are removed, overlapping windows merged. What is left of
a text keeps its order and its other lines.

Defined results: a null text stays null and an empty one empty, both with no lines; a text
of fewer than three lines is never changed; repeated rows are documents of their own, so
the second is emptied; an empty table stays empty; all other columns are kept as they are.

Scale: windows are (row, place, hash) rows. Finding the first ones is an aggregate that
combines before the shuffle; the join back has one row per repeated hash on one side, so a
very common passage is split like any skewed join. No group is gathered but the covered
places of one document. Texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import fresh, numbered_rows, quoted
from evalweave.session import materialise

_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    """(place, line) of every line with a word."""
    every = F.transform(
        F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("p"), x.alias("x"))
    )
    return F.filter(every, lambda line: line["x"].rlike(_WORD))


def _windows(lines: Column, width: int) -> Column:
    def window(i: Column) -> Column:
        part = F.slice(lines, i + 1, width)
        return F.struct(
            i.alias("w"),
            part["p"].alias("places"),
            F.unhex(F.md5(F.array_join(part["x"], "\n"))).alias("h"),
        )

    starts = F.sequence(F.lit(0), F.size(lines) - width)
    return F.when(F.size(lines) >= width, F.transform(starts, window))


def _without(text: Column, places: Column) -> Column:
    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in batches:
            out = []
            for text, drop in zip(texts, gone, strict=True):
                held = set(drop)
                lines = text.split("\n")
                out.append("\n".join(x for i, x in enumerate(lines) if i not in held))
            yield pd.Series(out, dtype=object)

    return cut(text, places)


def remove_repeated_windows(
    docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text", report: bool = False
) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``.

    With ``report`` also ``n_lines`` and ``removed``, the sorted places (from 0) of the lines
    that went; ``docs`` must then have no columns of these names.
    """
    row = fresh(docs, "_row")
    held = numbered_rows(docs, row, "lines")
    windows = materialise(
        held.select(quoted(row).alias("r"), quoted(key).alias("k"), _lines(quoted(text)).alias("l"))
        .select("r", "k", F.explode(_windows(F.col("l"), width)).alias("x"))
        .select("r", "k", "x.*"),
        "windows",
    )
    first = (
        windows.groupBy("h")
        .agg(F.min(F.struct("k", "r", "w")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h", F.col("first.r").alias("fr"), F.col("first.w").alias("fw"))
    )
    later = windows.join(first, "h").where("r <> fr or w <> fw")
    covered = later.groupBy("r").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("g")
    )
    covered = materialise(covered.select("r", F.col("g").alias("_gone")), "covered")
    cut, same = fresh(held, "_gone"), [c for c in docs.columns]
    # The same join at every size: the covered rows grow with the corpus.
    gone = covered.select(F.col("r").alias(row), F.col("_gone").alias(cut)).hint("merge")
    joined = held.join(gone, row, "left")
    # Only changed texts go through Python.
    safe = F.when(quoted(cut).isNotNull(), quoted(text))
    kept = F.when(
        quoted(cut).isNotNull(), _without(F.coalesce(safe, F.lit("")), F.coalesce(cut, F.array()))
    ).otherwise(quoted(text))
    out = [kept.alias(c) if c == text else quoted(c) for c in same]
    if report:
        n = F.coalesce(F.size(_lines(quoted(text))), F.lit(0))
        out += [
            F.when(quoted(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
            F.coalesce(cut, F.array()).cast("array<int>").alias("removed"),
        ]
    return joined.select(*out)


def dedup_report(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places as text) and the text that is left."""
    done = remove_repeated_windows(docs.select("doc_id", "text"), width, report=True)
    return done.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
        "text",
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p
  FROM documents
), full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), windows AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS h
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS r FROM windows WHERE h IS NOT NULL
), gone AS (
  SELECT DISTINCT f.doc_id, f.p FROM ranked JOIN range(3) t(j) ON true
  JOIN full_lines f ON f.doc_id = ranked.doc_id AND f.k = ranked.k + t.j WHERE r > 1
), dropped AS (
  SELECT doc_id, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS places FROM gone GROUP BY 1
), held AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p WHERE g.p IS NULL GROUP BY 1
), counted AS (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(x.n, 0) AS n_removed,
       coalesce(x.places, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(h.text, '') END AS text
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN dropped x USING (doc_id)
LEFT JOIN held h USING (doc_id)
"""
