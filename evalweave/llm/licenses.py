"""License notices by an exact set-similarity join, with DataFrame functions only.

Text blocks are windows of ``block_words`` words, each half a block after the one before. A
block meets a template if it holds at least ``threshold`` of the template's distinct words.
Words of the templates are ordered by how many documents of the corpus hold them, rarest
first. A block that shares enough words with a template of m words (need = ceil(threshold
* m)) must hold one of the template's first m - need + 1 words in that order: only those
prefixes are joined, on the word. Length filter: a block with fewer template words than the
need is dropped. Positional filter: after the words at places p and q of the two ordered
lists, no more than the shorter rest can still match. Survivors are verified, and must hold the
template's telling words, without which a notice of a neighbouring license would meet it. Blocks
are at least twice as long as the longest template. The SQL demands the same of every pair of a block and a template.

A phrase table gives the base labels, wherever a phrase's words stand consecutively.

Defined results: null text counts as empty: no words, null places, empty labels, score 0;
repeated rows are judged each; an empty table gives no rows; templates without words never
match, and at least one must have some. Other columns are ignored.

Scale: the templates are a parameter with at most ``_MOST_WORDS`` distinct words, checked, so
their table may be broadcast. Documents without any prefix word, nearly all, end at one scan;
only candidates' words are stored and cut into blocks. Shuffled are matches, not texts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.session import materialise

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Usual short notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike license"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
)

# What tells a template from the notices of neighbouring licenses. A block must
# also hold all of these, each as consecutive words.
TELLING = {
    "Released under the MIT License": ("mit",),
    "Licensed under the Apache License, Version 2.0": ("apache", "2"),
    "Licensed under CC BY-NC 4.0": ("nc",),
    "Licensed under a Creative Commons Attribution-ShareAlike license": ("attribution sharealike",),
    "This work is licensed under the GNU General Public License, version 3": ("gnu general public", "3"),
    "subject to the terms of the Mozilla Public License, v. 2.0": ("mozilla", "2"),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": (
        "person obtaining a copy",
    ),
}

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MOST_WORDS = 10_000


def plain_words(text: Column) -> Column:
    """The words of a text, one blank between them."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lower, _GAPS, " "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _count(words: Column) -> Column:
    return F.when(words == "", F.lit(0)).otherwise(_blanks(words) + 1).cast("long")


def base_matches(words: Column, n_words: Column, phrases=PHRASES) -> dict[str, Column]:
    """Columns n_base, first_word, last_word and base (array of labels) of joined words."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    hits, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        found = F.contains(padded, F.lit(f" {phrase} "))
        # A phrase cannot overlap itself; the blank after it may begin the next one.
        parts = F.split(padded, f" {phrase}(?= )", -1)
        size = len(phrase.split())
        hits.append(F.when(found, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(found, _blanks(F.element_at(parts, 1))))
        lasts.append(F.when(found, n_words - (_blanks(F.element_at(parts, -1)) - 1) - size))
        labels.append(F.when(found, F.lit(label)))
    return {
        "n_base": sum(hits[1:], hits[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


def _letters(text: str) -> str:
    lower = text.translate(str.maketrans(_UPPER, _LOWER))
    return "".join(c if c in _LOWER or c.isdigit() or ord(c) > 127 else " " for c in lower)


def template_words(text: str) -> list[str]:
    return sorted(set(_letters(text).split(" ")) - {""})


def _length(text: str) -> int:
    return len([w for w in _letters(text).split(" ") if w])


def word_order(words: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary, rarest first by the number of rows of ``words`` (column w) with it.

    One count per word of the vocabulary comes to the driver.
    """
    held = F.array_intersect(F.split("w", " "), F.array(*[F.lit(v) for v in vocabulary]))
    counts = words.select(F.explode(held).alias("v")).groupBy("v").count().collect()
    found = {r["v"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda v: (found.get(v, 0), v))


def _literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    def cell(x) -> Column:
        return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)

    cells = [F.struct(*[cell(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def containment_matches(
    texts: DataFrame,
    order: Sequence[str],
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
    block_words: int = 64,
    telling: Mapping[str, Sequence[str]] = TELLING,
) -> DataFrame:
    """(row, label, score): every pair of a block and a template that meets the threshold.

    ``texts`` has ``row`` and ``w``, the joined words.
    """
    spark = texts.sparkSession
    place = {w: i for i, w in enumerate(order)}
    index, whole = [], []
    for number, (label, text) in enumerate(templates):
        words = sorted(template_words(text), key=place.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        whole.append((number, label, words, len(words), need, [f" {t} " for t in telling.get(text, ())] or [" "]))
        index += [(w, number, p) for p, w in enumerate(words[: len(words) - need + 1])]
    whole_t = _literal_table(spark, ("template", "label", "words", "m", "need", "telling"), whole)
    index_t = _literal_table(spark, ("word", "template", "p"), index)
    ordered = F.array(*[F.lit(w) for w in order])
    # A notice of up to half a block stands whole in some block.
    longest = max(_length(text) for _, text in templates)
    block_words = max(block_words, 2 * longest)
    half = block_words // 2
    blocks = (
        texts.select("row", F.split("w", " ").alias("v"))
        .select("row", "v", F.explode(F.sequence(F.lit(0), F.size("v") - 1, F.lit(half))).alias("at"))
        # In corpus order, since the first list gives the order.
        .select("row", "at", F.slice("v", F.col("at") + 1, block_words).alias("v"))
        .select("row", "at", "v", F.array_intersect(ordered, "v").alias("held"))
        .where(F.size("held") >= min(x[4] for x in whole))
    )
    pairs = (
        blocks.select("row", "at", "v", "held", F.posexplode("held").alias("q", "word"))
        .join(F.broadcast(index_t), "word")
        .join(F.broadcast(whole_t), "template")
        .where(F.size("held") >= F.col("need"))
        .where(1 + F.least(F.col("m") - F.col("p"), F.size("held") - F.col("q")) - 1 >= F.col("need"))
    )
    share = F.size(F.array_intersect("words", "held")) / F.col("m")
    block = F.concat(F.lit(" "), F.array_join("v", " "), F.lit(" "))
    return pairs.withColumn("score", share).where(
        F.size(F.array_intersect("words", "held")) >= F.col("need")
    ).where(F.forall("telling", lambda t: F.contains(block, t))).select("row", "label", "score")


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.8,
    block_words: int = 64,
    telling: Mapping[str, Sequence[str]] = TELLING,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = [t for t in templates if template_words(t[1])]
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    if not vocabulary:
        raise ValueError("no template holds a word")
    if len(vocabulary) > _MOST_WORDS:
        raise ValueError(f"templates hold more than {_MOST_WORDS} distinct words")
    order = word_order(docs.select(plain_words(F.col("text")).alias("w")), vocabulary)
    prefixes = set()
    for _, text in templates:
        words = sorted(template_words(text), key=order.index)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefixes |= set(words[: len(words) - need + 1])
    named = docs.select("doc_id", plain_words(F.col("text")).alias("w")).withColumn(
        "n_words", _count(F.col("w"))
    )
    base = base_matches(F.col("w"), F.col("n_words"), phrases)
    candidate = F.arrays_overlap(
        F.split("w", " "), F.array(*[F.lit(p) for p in sorted(prefixes)])
    )
    rows = materialise(
        named.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_words",
            *[c.alias(n) for n, c in base.items()],
            F.when(candidate, F.col("w")).alias("w"),
        ),
        "licenses",
    )
    matches = containment_matches(
        rows.where("w is not null and w <> ''").select("row", "w"), order, templates, threshold, block_words, telling
    )
    per_row = matches.groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best")
    )
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("w").join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        score.alias("score"),
    )


def oracle(threshold: float = 0.8, block_words: int = 64) -> str:
    """The same by comparing every block with every template."""
    chosen = ", ".join(
        f"('{label}', {template_words(text)}, {[f' {t} ' for t in TELLING.get(text, ())] or [' ']})"
        for label, text in TEMPLATES
    )
    block_words = max(block_words, 2 * max(_length(text) for _, text in TEMPLATES))
    phrases = ", ".join(f"('{p}', {p.split()}, '{label}')" for p, label in PHRASES)
    return f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(
      translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_GAPS}', ' ', 'g'), ' '),
      lambda x: x <> '') AS w FROM documents
), templates(label, t, telling) AS (VALUES {chosen}), phrases(phrase, p, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, i, p, label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words) JOIN phrases
  ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
), base AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1
), blocks AS (
  SELECT doc_id, b, concat(' ', array_to_string(b, ' '), ' ') AS s FROM (
  SELECT doc_id, w[o + 1 : o + {block_words}] AS b
  FROM (SELECT doc_id, w, unnest(range(0, len(w), {block_words // 2})) AS o FROM words))
), shared AS (
  SELECT doc_id, label, len(list_intersect(t, b)) AS n, len(t) AS m FROM blocks, templates
  WHERE len(list_filter(telling, lambda x: NOT contains(s, x))) = 0
), found AS (
  SELECT doc_id, label, max(n / m) AS s FROM shared WHERE n >= ceil({threshold} * m - 1e-9) GROUP BY 1, 2
), best AS (SELECT doc_id, max(s) AS s FROM found GROUP BY 1), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM places) GROUP BY 1
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base,
       base.a::BIGINT AS first_word, base.b::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.s, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id)
"""
