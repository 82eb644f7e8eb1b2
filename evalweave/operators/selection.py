"""Quota-constrained balanced selection and its reports.

The selection goes round over model families: each round takes from every family its next
item whose original is still below the cap, and an item met above the cap is passed over for
good. So a selected item's round is the number of items selected before it in its family,
and an item is selected if and only if fewer than ``cap`` items of its original stand at
earlier positions (round, family).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.draws import hash60
from evalweave.functions.text import UNKNOWN_FAMILY, model_family, text_key, without_org
from evalweave.operators.ordering import global_rank, with_constants
from evalweave.operators.prefixes import first_prefix
from evalweave.operators.quality import is_used, pending_pool
from evalweave.operators.resume import representation_counts, with_representation
from evalweave.session import materialise


def with_family(items: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Add the model family of ``source``; a missing source is unknown.

    ``families`` (prefix, value, ord) takes the place of the built-in list of prefixes.
    """
    if families is None:
        return items.withColumn("family", model_family("source"))
    raw = text_key("source")
    named = items.withColumn("_name", without_org(raw))
    family = F.when(raw == "", F.lit(UNKNOWN_FAMILY)).otherwise(F.coalesce("family", "_name"))
    return first_prefix(named, "_name", families, "family").withColumn("family", family).drop("_name")


def family_breakdown(items: DataFrame, families: DataFrame | None = None) -> DataFrame:
    return (
        with_family(items, families).groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy("family")
    )


def max_id_number(entries: DataFrame, prefix: str = "alt_") -> DataFrame:
    """One row: the largest number among ids ``prefix<digits>``, 0 if there is none."""
    number = F.expr(
        f"try_cast(nullif(regexp_extract(coalesce(id, ''), '^{prefix}([0-9]+)', 1), '') AS BIGINT)"
    )
    return entries.agg(F.coalesce(F.max(number), F.lit(0).cast("long")).alias("base"))


def with_quota(pool: DataFrame, existing: DataFrame | None, cap: int | None) -> DataFrame:
    """Pending items with ``blocked`` and ``room``: how many of their original may follow.

    ``room`` is NULL where no cap applies: cap off, or empty original.
    """
    keyed = pending_pool(pool).withColumn("original_key", text_key("original_riddle"))
    if existing is None:
        counted = keyed.withColumn("n", F.lit(0).cast("long"))
    else:
        counted = keyed.join(representation_counts(existing), "original_key", "left")
    room = F.lit(None).cast("long")
    if cap:
        room = F.when(F.col("original_key") != "", F.lit(cap) - F.coalesce("n", F.lit(0)))
    return (
        counted.withColumn("room", room)
        .withColumn("blocked", F.coalesce(F.col("room") <= 0, F.lit(False)))
        .drop("n")
    )


def eligibility(pool: DataFrame, existing: DataFrame | None, cap: int | None) -> DataFrame:
    """One row: pending, eligible and blocked counts."""
    return with_quota(pool, existing, cap).agg(
        F.count(F.lit(1)).alias("pending"),
        F.count_if(~F.col("blocked")).alias("eligible"),
        F.count_if("blocked").alias("blocked"),
    )


def top_blocked(
    pool: DataFrame, existing: DataFrame | None, cap: int | None, n: int = 5
) -> DataFrame:
    """The ``n`` originals that block most items; names break ties."""
    return (
        with_quota(pool, existing, cap)
        .where("blocked")
        .groupBy("original_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "original_key")
        .limit(n)
    )


def pool_report(auxiliary: DataFrame, fixed: DataFrame, pool: DataFrame) -> DataFrame:
    """(part, family, n): totals, pool states, and both states by family."""
    items = with_family(pool).withColumn("part", F.when(is_used(), "used").otherwise("pending"))
    states = (
        items.groupingSets([[], ["part"], ["part", "family"]], "part", "family")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
        .select(F.coalesce("part", F.lit("pool")).alias("part"), "family", "n")
    )

    def total(df: DataFrame, part: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(part).alias("part"), F.lit(None).cast("string").alias("family"), "n"
        )

    sets = total(auxiliary, "auxiliary").union(total(fixed, "fixed"))
    both = sets.agg(F.sum("n").alias("n")).select(
        F.lit("total").alias("part"), F.lit(None).cast("string").alias("family"), "n"
    )
    return sets.union(both).union(states)


def _candidates(pool: DataFrame, existing: DataFrame | None, cap: int | None) -> DataFrame:
    """(ord, family, family_ord, original_key, room, contested) of items that may be taken.

    One family takes items of an original in pool order, so only its first ``room`` ones can
    ever be taken. An original with no more candidates than room is never blocked; the
    others are contested.
    """
    open_items = with_quota(pool, existing, cap)
    families = (
        with_family(pending_pool(pool)).groupBy("family").agg(F.min("ord").alias("_first"))
    )
    # One row per model family.
    ordered = families.select(
        "family", F.row_number().over(Window.orderBy("_first")).cast("long").alias("family_ord")
    )
    items = (
        with_family(open_items.where(~F.col("blocked")))
        .join(ordered, "family")
        .select("ord", "family_ord", "original_key", "room")
    )
    free = items.where("room IS NULL").withColumn("contested", F.lit(False))
    if not cap:
        return free
    # The filter on row_number <= cap is applied before the shuffle too, per task.
    mine = Window.partitionBy("family_ord", "original_key").orderBy("ord")
    capped = (
        items.where("room IS NOT NULL")
        .withColumn("_rn", F.row_number().over(mine))
        .where(F.col("_rn") <= cap)
        .where("_rn <= room")
        .drop("_rn")
    )
    # After that, an original has at most cap rows per family.
    per_original = capped.groupBy("original_key").agg(F.count(F.lit(1)).alias("_all"))
    capped = (
        capped.join(per_original, "original_key")
        .withColumn("contested", F.col("_all") > F.col("room"))
        .select("ord", "family_ord", "original_key", "room", "contested")
    )
    return free.unionByName(capped)


def _played(rows: DataFrame) -> DataFrame:
    """Adds ``at``, the round of every contested row if just the rows ``taken`` are selected.

    Running counts are kept per block of 2**16 rows of a family, so no task holds a family.
    """
    rows = rows.withColumn("_b", F.shiftright(F.col("pos") - 1, 16))
    one = F.col("taken").cast("long")
    earlier = (Window.unboundedPreceding, -1)
    ahead = F.sum("_m").over(Window.partitionBy("family_ord").orderBy("_b").rowsBetween(*earlier))
    blocks = rows.groupBy("family_ord", "_b").agg(F.sum(one).alias("_m")).withColumn("_ahead", ahead).drop("_m")
    inside = F.sum(one).over(Window.partitionBy("family_ord", "_b").orderBy("pos").rowsBetween(*earlier))
    at = F.col("base") + F.coalesce("_ahead", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return (
        rows.withColumn("_inside", inside)
        .join(blocks, ["family_ord", "_b"])
        .withColumn("at", at)
        .drop("_b", "_inside", "_ahead")
    )


def _contested_decisions(candidates: DataFrame, limit: int | None) -> DataFrame | None:
    """(ord, taken) of contested candidates.

    Decisions fix the rounds of all rows, and rounds fix the decisions: an original takes its
    first ``room`` rows in order of round and family. Starting with everything taken, both
    are worked out in turn until no decision changes. There is one such state only, the one that
    playing row by row reaches: a row's round hangs on earlier rows of its family, its
    decision on earlier rows of its original. Each pass settles at least one more row in play
    order, for its round is right once all earlier decisions are, and no later row can get
    ahead of it; independent rows settle at once, so a few passes do. A change at round r leaves
    all rows before r as they are, so with ``limit`` play ends once the first ``limit`` rounds stand.
    """
    if candidates.where("contested").isEmpty():
        return None
    ranked = global_rank(
        candidates.where("contested"), "ord", by=["family_ord"], name="pos"
    )
    # Surely selected rows before a contested one: its rank among all minus that among contested.
    everywhere = global_rank(candidates, "ord", by=["family_ord"], name="any_pos").select(
        "ord", "any_pos"
    )
    base = F.col("any_pos") - F.col("pos")
    state = materialise(
        ranked.join(everywhere, "ord")
        .select("ord", "family_ord", "original_key", "room", "pos", base.alias("base"), F.lit(True).alias("taken"))
        .where(F.lit(True) if limit is None else base < limit),
        "contested",
    )
    turn = Window.partitionBy("original_key").orderBy("at", "family_ord", "pos")

    def judged(rows: DataFrame) -> DataFrame:
        return _played(rows).withColumn("now", F.row_number().over(turn) <= F.col("room"))

    def settled(rows: DataFrame) -> DataFrame:
        return rows.drop("taken", "at").withColumnRenamed("now", "taken")

    while True:
        # Two passes are stored at once.
        last = materialise(judged(settled(judged(state))), "judged")
        first_change = last.where("taken <> now").agg(F.min("at")).first()[0]
        state = settled(last)
        if first_change is None or (limit is not None and first_change >= limit):
            return state.select("ord", "taken")


def balanced_order(
    pool: DataFrame,
    cap: int | None = None,
    existing: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(ord, pick): every item that the rounds take, numbered in the order they take it.

    With ``limit``, only the first ``limit`` picks are sure to be right, and later turns of
    contested items are not settled. Writes intermediate tables to the scratch folder when a cap leads to contested items.
    """
    candidates = _candidates(pool, existing, cap)
    taken = candidates
    if cap:
        candidates = materialise(candidates, "candidates")
        decisions = _contested_decisions(candidates, limit)
        taken = candidates
        if decisions is not None:
            taken = candidates.join(decisions, "ord", "left").where("NOT contested OR taken")
    rounds = global_rank(
        taken.select("ord", "family_ord"), "ord", by=["family_ord"], name="_round"
    )
    families = rounds.agg((F.max("family_ord") + 1).alias("_families"))
    position = F.col("_round") * F.col("_families") + F.col("family_ord")
    placed = with_constants(rounds, families).select("ord", position.alias("_pos"))
    return global_rank(placed, "_pos", name="pick").select("ord", "pick")


def balanced_pick(
    pool: DataFrame,
    count: int | DataFrame,
    cap: int | None = None,
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(selected with ``pick``, pool with the selected items marked as used).

    ``count`` is a number or a one-row DataFrame with the column ``count``. ``used_set`` is
    the item's own set where it has one, else ``benchmark``.
    """
    if isinstance(count, DataFrame):
        count = count.first()["count"]
    order = balanced_order(pool, cap, existing, limit=count)
    chosen = materialise(order.where(F.col("pick") <= count), "picks")
    selected = pool.join(chosen, "ord")
    own = F.nullif("set", F.lit("")) if "set" in pool.columns else F.lit(None).cast("string")
    known = F.col("used_set") if "used_set" in pool.columns else F.lit(None).cast("string")
    hit = F.col("pick").isNotNull()
    marked = (
        pool.join(chosen, "ord", "left")
        .withColumns(
            {
                "used_set": F.when(hit, F.coalesce(own, F.lit("benchmark"))).otherwise(known),
                "used_in_set": F.when(hit, F.lit(True)).otherwise(F.col("used_in_set")),
            }
        )
        .drop("pick")
    )
    return selected, marked


def least_represented(
    source: DataFrame, raw: DataFrame, count: int, seed: int = 0
) -> DataFrame:
    """``count`` picks of source items, least represented first, cycling when they run out.

    Ties are broken by a hash of (seed, item), so a rerun picks the same items.
    """
    counted = with_representation(source, raw)
    tie = F.shiftright(hash60(F.lit(str(seed)), F.col("riddle_idx").cast("string")), 28)
    # Distinct counts are numbered, as different ones are few: n of them take n^2 / 2 rows.
    levels = global_rank(counted.select("n").distinct(), "n", name="_level", start=0)
    order = F.col("_level") * F.lit(2**32) + tie
    ranked = global_rank(
        counted.join(levels, "n").withColumn("_order", order), "_order", tiebreak=["riddle_idx"],
        name="_p", start=0,
    ).drop("_order", "_level")
    picks = source.sparkSession.range(count).withColumnRenamed("id", "call_idx")
    size = ranked.agg(F.count(F.lit(1)).alias("_size"))
    turns = with_constants(picks, size).where("_size > 0").select(
        "call_idx", (F.col("call_idx") % F.col("_size")).alias("_p")
    )
    return turns.join(ranked, "_p").drop("_p")
