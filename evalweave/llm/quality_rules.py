"""Quality rules with cutoffs whose false-rejection risk is bounded on labelled holdouts.

Every rule rejects a document whose statistic is above a cutoff. For each stratum one sequence
of joint cutoffs, all rules tightened together, is tested from the most lenient to the
strictest on labelled good documents: a step is safe if the exact binomial (Clopper-Pearson)
upper bound of the share rejected by any rule stays within ``risk``. The walk stops at
the first step that cannot be shown safe (fixed-sequence testing), and the error probability
is split over strata (Bonferroni), so with probability ``1 - error`` every stratum loses at
most ``risk`` of its good documents to the rules.

A rule that suits no document of a stratum (word lengths, where words have no blanks) would end
the walk for all. So there are several walks, fixed before any label is read: with all rules, then with
each one left out. The first has half of the stratum's error, the others share the other half, and a
walk that is shown safe to its end passes its share on to the next (fallback procedure). All claims
hold together within the error, so the strictest result may be chosen. The procedure is the same at
every size. Without rejections, four strata and five rules the first walk needs 252 good labels,
one of the others 331 (``labels_needed`` of its share).

Defined results: a null text counts as empty; a document without words has zero counts and
fails the base rules; a null stratum is a stratum of its own; a stratum with too few labels
gets no cutoffs, and its documents pass the rules; repeated labels of one document count
once, as the lowest; repeated rows are judged each, but are one holdout, rejected if one of them is; without labels or documents nothing is
rejected by cutoffs. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import raw_text
from evalweave.session import materialise

_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
)
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects if ``statistic`` is above a cutoff; ``cutoffs`` go from lenient to strict."""

    name: str
    statistic: str
    cutoffs: tuple[float, ...]


#: Statistics are per word, so that they compare over lengths.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (4.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("lines", "n_dup_lines / greatest(n_words, 1)", (0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (30.0, 20.0, 15.0, 12.0, 10.0)),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", (-1.5, -2.0, -2.5, -3.0)),
)


def rule_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """The counts of one text: words, their code points, symbols, repeated lines and words."""
    words = raw.split()
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        covered = bytearray(len(words))
        for i, window in enumerate(windows):
            if found[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def text_counts(text: str | Column = "text") -> Column:
    """A struct of the counts that the rules use."""
    names = [x.split()[0] for x in _COUNTS.split(", ")]

    @F.pandas_udf(_COUNTS)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([rule_counts(t) for t in texts], columns=names).astype("int64")

    return counts(raw_text(text))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial, summed from its largest term downwards."""
    if k >= n:
        return 1.0
    if k > n * p:  # the upper tail is the short one
        return 1.0 - binomial_cdf(n - k - 1, n, 1 - p)
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for j in range(k, -1, -1):
        total += term
        if term <= total * 1e-18:
            break
        term *= j * (1 - p) / ((n - j + 1) * p)
    return min(total, 1.0)


def safe_cutoff(
    rejected: Sequence[int], n: int, cutoffs: Sequence[float], risk: float, error: float
) -> float | None:
    """The strictest cutoff reached while each one tested is shown safe; None if none is."""
    found = None
    for k, cutoff in zip(rejected, cutoffs, strict=True):
        if n == 0 or binomial_cdf(int(k), n, risk) > error:
            break
        found = cutoff
    return found


def labels_needed(risk: float, error: float) -> int:
    """The least number of good labels, none rejected, that shows a cutoff safe."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def walks_of(n_rules: int, error: float) -> list[tuple[list[int], float]]:
    """(rules, share of the error) of every walk, in the order in which they are tested."""
    every = list(range(n_rules))
    if n_rules < 2:
        return [(every, error)]
    less = [([r for r in every if r != out], error / 2 / n_rules) for out in every]
    return [(every, error / 2), *less]


def joint_cutoffs(
    firsts: np.ndarray, counts: np.ndarray, sizes: Sequence[int], risk: float, error: float
) -> list[int | None]:
    """The place of every rule's cutoff, None without one.

    ``firsts`` has, per kind of good document, the first cutoff of each rule that rejects it
    (the number of cutoffs: none does), and ``counts`` how many there are.
    """
    levels = max(sizes, default=0)
    # Rules with fewer cutoffs take smaller steps, so that all end at once.
    steps = [[i * (size - 1) // max(1, levels - 1) for size in sizes] for i in range(levels)]
    best: list[int | None] = [None] * len(sizes)
    most, spare = 0, 0.0
    for rules, share in walks_of(len(sizes), error):
        held = firsts[:, rules]
        rejected = [counts[(held <= np.array(step)[rules]).any(axis=1)].sum() for step in steps]
        level = safe_cutoff(rejected, int(counts.sum()), range(levels), risk, share + spare)
        spare = share + spare if level is not None and level == levels - 1 else 0.0
        if level is None:
            continue
        reached = [steps[level][r] if r in rules and sizes[r] else None for r in range(len(sizes))]
        strict = sum(i + 1 for i in reached if i is not None)
        if strict > most:
            best, most = reached, strict
    return best


def learn_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    stratum: str = "stratum",
    rules: Sequence[Rule] = RULES,
    risk: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """(stratum, one cutoff per rule): one row per stratum with good labelled documents.

    ``counted`` has ``doc_id``, the stratum and the counts; ``labels`` has ``doc_id`` and
    ``quality`` (1: good). Only (doc_id, counts) rows are shuffled, and what is gathered per
    stratum is a row per combination of the cutoffs that reject, at most a few thousand.
    """
    good = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    # The first cutoff that rejects a document tells all later ones.
    first = [
        (
            F.size(F.array_compact(F.array(*[F.when(F.expr(r.statistic) <= c, 1) for c in r.cutoffs])))
            if r.cutoffs
            else F.lit(0)
        ).alias(f"first_{r.name}")
        for r in rules
    ]
    names = [f"first_{r.name}" for r in rules]
    table = materialise(
        counted.where(~base_failed())
        .join(good, "doc_id", "left_semi")
        .select("doc_id", F.col(stratum).alias("stratum"), *first)
        # Repeated rows are no further holdouts.
        .groupBy("doc_id", "stratum")
        .agg(*[F.min(n).alias(n) for n in names])
        .groupBy("stratum", *names)
        .agg(F.count(F.lit(1)).alias("n")),
        "holdout",
    )
    share = error / max(1, table.select("stratum").distinct().count())
    sizes = [len(r.cutoffs) for r in rules]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts = pdf[names].to_numpy(np.int64)
        chosen = joint_cutoffs(firsts, pdf["n"].to_numpy(), sizes, risk, share)
        out = pdf[["stratum"]].iloc[:1].assign(n_good=int(pdf["n"].sum()))
        for r, at in zip(rules, chosen, strict=True):
            out[r.name] = np.nan if at is None else float(r.cutoffs[at])
        return out

    kind = dict(table.dtypes)["stratum"]
    schema = f"stratum {kind}, n_good long, " + ", ".join(f"{r.name} double" for r in rules)
    return materialise(table.groupBy("stratum").applyInPandas(choose, schema), "cutoffs")


def judge(
    counted: DataFrame,
    cutoffs: DataFrame,
    stratum: str = "stratum",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept`` to the counted documents."""
    cut = cutoffs.select(
        F.col("stratum").alias("_s"), *[F.col(r.name).alias(f"_{r.name}") for r in rules]
    )
    joined = counted.join(cut, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    failed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.isnan(F.col(f"_{r.name}")) & (F.expr(r.statistic) > F.col(f"_{r.name}")),
                    F.lit(r.name),
                )
                for r in rules
            ]
        )
    )
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_s", *[f"_{r.name}" for r in rules])
    )


def risk_controlled_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    rules: Sequence[Rule] = RULES,
    risk: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, failed_rules and kept for every document."""
    counted = materialise(
        docs.select("doc_id", F.col(stratum).alias("stratum"), text_counts().alias("c")).select(
            "doc_id", "stratum", "c.*"
        ),
        "counts",
    )
    return judge(counted, learn_cutoffs(counted, labels, "stratum", rules, risk, error), rules=rules)
