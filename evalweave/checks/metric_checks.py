"""Queries for aggregates, windows and coverage over evaluated samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.checks.fixtures import Fixtures, with_views
from evalweave.checks.registry import check, rounded, text
from evalweave.functions.text import model_key
from evalweave.operators import bootstrap, coverage, metrics, ordering, quality, resume
from evalweave.plans import evaluation
from evalweave.session import materialise

R4 = "CAST(format('{{:.4f}}', {0}) AS DOUBLE)"


def r4(expr: str) -> str:
    """Four decimals by the exact binary value, as DuckDB text formatting does it."""
    return R4.format(expr)


def mean(expr: str, where: str = "TRUE") -> str:
    """Mean of values in steps of 1e-12, independent of row order."""
    return f"(sum(CAST({expr} AS DECIMAL(28,12))) FILTER ({where}) / count({expr}) FILTER ({where}))"


# (run, item) statistics shared by many checks.
ITEM = """
item AS (
  SELECT run_id, riddle_id,
         count(*) FILTER (riddle_type = 'altered') AS n,
         coalesce(sum(CAST(correct AS INT)) FILTER (riddle_type = 'altered'), 0) AS n_correct,
         coalesce(sum(CAST(gave_original_answer AS INT)) FILTER (riddle_type = 'altered'), 0) AS n_override,
         count(*) FILTER (riddle_type = 'original') AS n_original,
         coalesce(sum(CAST(correct AS INT)) FILTER (riddle_type = 'original'), 0) AS n_original_correct
  FROM fx_details GROUP BY run_id, riddle_id),
per_riddle AS (
  SELECT i.*, n_override / n AS override_mean, n_correct / n AS accuracy_mean,
         n_original_correct > 0 AS solved,
         CASE WHEN e.id IS NULL THEN i.riddle_id ELSE e.original_riddle END AS cluster, e.type
  FROM item i LEFT JOIN fx_entries e ON i.riddle_id = e.id WHERE n > 0)"""

REP = """
rep AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, riddle_id, riddle_type
                                 ORDER BY CASE WHEN sample_index = 1 THEN 0 ELSE 1 END, ord) AS rn
    FROM fx_details) x WHERE rn = 1)"""


def _per_riddle(fx: Fixtures):
    return metrics.per_riddle_stats(fx.details, fx.entries)


@check(
    "d1_run_summary",
    with_views("details") + f""",{REP}
SELECT run_id, count(*) FILTER (riddle_type = 'original') AS original_total,
       CAST(count(*) FILTER (riddle_type = 'original' AND correct) AS BIGINT) AS original_correct,
       {r4("count(*) FILTER (riddle_type = 'original' AND correct) / count(*) FILTER (riddle_type = 'original')")} AS original_accuracy,
       count(*) FILTER (riddle_type = 'altered') AS altered_total,
       count(*) FILTER (riddle_type = 'altered' AND correct) AS altered_correct,
       {r4("count(*) FILTER (riddle_type = 'altered' AND correct) / count(*) FILTER (riddle_type = 'altered')")} AS altered_accuracy,
       {r4("count(*) FILTER (riddle_type = 'altered' AND gave_original_answer) / count(*) FILTER (riddle_type = 'altered')")} AS pattern_override_rate
FROM rep GROUP BY run_id""",
)
def d1_run_summary(fx: Fixtures):
    return metrics.run_summary(fx.details).drop(
        "conditioned_override_total", "conditioned_override_count", "conditioned_override_rate"
    )


@check(
    "d2_conditioned_override",
    with_views("details") + f""",
item AS (
  SELECT run_id, riddle_id, count(*) FILTER (riddle_type = 'altered') AS n,
         count(*) FILTER (riddle_type = 'altered' AND gave_original_answer) AS k,
         count(*) FILTER (riddle_type = 'original' AND correct) AS solved
  FROM fx_details GROUP BY ALL)
SELECT run_id, count(*) FILTER (n > 0 AND solved > 0) AS conditioned_override_total,
       CAST(coalesce(sum(k) FILTER (n > 0 AND solved > 0), 0) AS BIGINT) AS conditioned_override_count,
       {r4('coalesce(' + mean('k / nullif(n, 0)', 'n > 0 AND solved > 0') + ', 0.0)')} AS conditioned_override_rate
FROM item GROUP BY run_id""",
)
def d2_conditioned_override(fx: Fixtures):
    return metrics.run_summary(fx.details).select(
        "run_id",
        "conditioned_override_total",
        "conditioned_override_count",
        "conditioned_override_rate",
    )


@check(
    "d3_token_totals",
    with_views("outputs") + """
SELECT run_id, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
       CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens
FROM fx_outputs GROUP BY run_id""",
)
def d3_token_totals(fx: Fixtures):
    return metrics.token_totals(fx.outputs)


@check(
    "d4_per_riddle_stats",
    with_views("details", "entries") + f""",{ITEM}
SELECT run_id, riddle_id, cluster, round(override_mean, 6) AS override_mean,
       round(accuracy_mean, 6) AS accuracy_mean, n AS sample_count,
       CAST(round(n_original_correct / nullif(n_original, 0), 6) AS VARCHAR) AS original_accuracy_mean,
       CAST(solved AS VARCHAR) AS original_solved
FROM per_riddle""",
)
def d4_per_riddle_stats(fx: Fixtures):
    return _per_riddle(fx).select(
        "run_id",
        "riddle_id",
        "cluster",
        rounded("override_mean"),
        rounded("accuracy_mean"),
        "sample_count",
        text(F.round("original_accuracy_mean", 6), "original_accuracy_mean"),
        text("original_solved"),
    )


BOARD = f"""
rep AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, riddle_id, riddle_type
                                 ORDER BY CASE WHEN sample_index = 1 THEN 0 ELSE 1 END, ord) AS rn
    FROM fx_details) x WHERE rn = 1),
tokens AS (
  SELECT run_id, min(ord) AS run_ord, coalesce(sum(input_tokens), 0) AS tin, coalesce(sum(output_tokens), 0) AS tout
  FROM fx_outputs GROUP BY run_id),
board AS (
  SELECT run_id, {mean('accuracy_mean')} AS altered_accuracy,
         coalesce({mean('override_mean', 'solved')}, 0) AS cor,
         coalesce(sum(n_override) FILTER (solved), 0) AS override_samples,
         count(*) AS n_items, count(*) FILTER (solved) AS n_solved, avg(n) AS avg_samples, sum(n) AS samples
  FROM per_riddle GROUP BY run_id)"""


def _summary(fx: Fixtures):
    outputs = fx.outputs
    return (
        quality.checked_run_metadata(outputs)
        .join(metrics.token_totals(outputs), "run_id")
        .join(metrics.run_summary(fx.details), "run_id")
    )


def _board(fx: Fixtures):
    return evaluation.ranked(metrics.board_metrics(_per_riddle(fx), _summary(fx)))


def _stored(fx: Fixtures):
    """Per-item statistics and the ranked board, written once and used by several steps."""
    per_riddle = materialise(_per_riddle(fx), "per_riddle")
    ranked = evaluation.ranked(metrics.board_metrics(per_riddle, _summary(fx)))
    return per_riddle, materialise(ranked, "board")


@check(
    "d5_board_metrics",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD}
SELECT run_id, round(altered_accuracy, 6) AS altered_accuracy, round(cor, 6) AS conditioned_override_rate,
       CAST(override_samples AS BIGINT) AS conditioned_override_total,
       CAST(tin AS BIGINT) AS total_input_tokens, CAST(tout AS BIGINT) AS total_output_tokens,
       round(tin / samples, 6) AS avg_input_tokens_per_riddle,
       round(tout / samples, 6) AS avg_output_tokens_per_riddle,
       round(avg_samples, 6) AS avg_samples_per_riddle,
       n_items AS unique_altered_riddles, n_solved AS conditioned_unique_altered_riddles
FROM board JOIN tokens USING (run_id)""",
)
def d5_board_metrics(fx: Fixtures):
    return _board(fx).select(
        "run_id",
        rounded("altered_accuracy"),
        rounded("conditioned_override_rate"),
        "conditioned_override_total",
        "total_input_tokens",
        "total_output_tokens",
        rounded("avg_input_tokens_per_riddle"),
        rounded("avg_output_tokens_per_riddle"),
        rounded("avg_samples_per_riddle"),
        "unique_altered_riddles",
        "conditioned_unique_altered_riddles",
    )


@check(
    "e2_ranked_board",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD}
SELECT row_number() OVER (ORDER BY cor, altered_accuracy DESC, run_ord) AS rank, run_id,
       round(cor, 6) AS conditioned_override_rate, round(altered_accuracy, 6) AS altered_accuracy
FROM board JOIN tokens USING (run_id)""",
)
def e2_ranked_board(fx: Fixtures):
    return _board(fx).select(
        "rank", "run_id", rounded("conditioned_override_rate"), rounded("altered_accuracy")
    )


@check(
    "f1_board_sort",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD}
SELECT run_id, round(cor, 6) AS conditioned_override_rate FROM board JOIN tokens USING (run_id)
ORDER BY cor, altered_accuracy DESC, run_ord""",
)
def f1_board_sort(fx: Fixtures):
    return (
        _board(fx)
        .orderBy(F.asc("conditioned_override_rate"), F.desc("altered_accuracy"), F.asc("run_ord"))
        .select("run_id", rounded("conditioned_override_rate"))
    )


@check(
    "e1_representative_samples",
    with_views("details") + f""",{REP}
SELECT run_id, riddle_id, riddle_type, sample_index, ord, CAST(correct AS VARCHAR) AS correct FROM rep""",
)
def e1_representative_samples(fx: Fixtures):
    return ordering.representative_samples(fx.details).select(
        "run_id", "riddle_id", "riddle_type", "sample_index", "ord", text("correct")
    )


@check(
    "e5_last_judgment_wins",
    with_views("judgments") + """
SELECT run_id, riddle_id, riddle_type, sample_index, CAST(correct AS VARCHAR) AS correct,
       CAST(gave_original AS VARCHAR) AS gave_original
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, riddle_id, riddle_type, sample_index ORDER BY ord DESC) AS rn
      FROM fx_judgments) j WHERE rn = 1""",
)
def e5_last_judgment_wins(fx: Fixtures):
    return ordering.last_wins(fx.judgments, resume.OUTPUT_KEY).select(
        *resume.OUTPUT_KEY, text("correct"), text("gave_original")
    )


@check(
    "e3_sequential_ids",
    with_views("entries") + """
SELECT ord, printf('new_%04d', 17 + row_number() OVER (ORDER BY ord)) AS id
FROM fx_entries WHERE set_name = 'auxiliary'""",
)
def e3_sequential_ids(fx: Fixtures):
    rows = fx.entries.where("set_name = 'auxiliary'").select("ord")
    return ordering.with_sequential_id(rows, "new_", 17)


@check(
    "e7_position_index",
    with_views("sanity_answers") + """
SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS riddle_idx FROM fx_sanity_answers WHERE model_answer <> ''""",
)
def e7_position_index(fx: Fixtures):
    rows = fx.sanity_answers.where("model_answer <> ''").select("ord")
    return ordering.zero_based_index(rows)


EXPECTED = """
expected AS (
  SELECT 'altered' AS riddle_type, id AS riddle_id FROM fx_entries
  UNION
  SELECT 'original', arg_min(id, ord) FROM fx_entries WHERE original_riddle <> '' GROUP BY original_riddle),
seen AS (SELECT DISTINCT run_id, riddle_type, riddle_id FROM fx_details)"""


@check(
    "d16_expected_coverage",
    with_views("entries", "details") + f""",{EXPECTED} SELECT riddle_type, riddle_id FROM expected""",
)
def d16_expected_coverage(fx: Fixtures):
    return coverage.expected_coverage(fx.entries)


@check(
    "c13_complete_runs",
    with_views("entries", "details") + f""",{EXPECTED},
runs AS (SELECT DISTINCT run_id FROM fx_details)
SELECT run_id FROM runs r WHERE NOT EXISTS (
  SELECT 1 FROM expected e WHERE NOT EXISTS (
    SELECT 1 FROM seen s WHERE s.run_id = r.run_id AND s.riddle_type = e.riddle_type AND s.riddle_id = e.riddle_id))""",
)
def c13_complete_runs(fx: Fixtures):
    return coverage.complete_runs(fx.runs, fx.details, fx.entries).select("run_id")


@check(
    "c13_coverage_report",
    with_views("entries", "details") + f""",{EXPECTED},
runs AS (SELECT DISTINCT run_id FROM fx_details)
SELECT run_id, count(*) FILTER (e.riddle_type = 'altered') AS expected_altered,
       count(*) FILTER (e.riddle_type = 'altered' AND s.run_id IS NULL) AS missing_altered,
       count(*) FILTER (e.riddle_type = 'original') AS expected_original,
       count(*) FILTER (e.riddle_type = 'original' AND s.run_id IS NULL) AS missing_original
FROM runs CROSS JOIN expected e LEFT JOIN seen s USING (run_id, riddle_type, riddle_id) GROUP BY run_id""",
)
def c13_coverage_report(fx: Fixtures):
    return coverage.coverage_report(fx.runs, fx.details, fx.entries)


@check(
    "g3_expected_minus_seen",
    with_views("entries", "details") + f""",{EXPECTED},
runs AS (SELECT DISTINCT run_id FROM fx_details)
SELECT run_id, riddle_type, riddle_id FROM runs CROSS JOIN expected
EXCEPT SELECT run_id, riddle_type, riddle_id FROM seen""",
)
def g3_expected_minus_seen(fx: Fixtures):
    return coverage.missing_items(fx.runs, fx.details, fx.entries)


@check(
    "g5_distinct_ids",
    with_views("details") + "\nSELECT DISTINCT run_id, riddle_type, riddle_id FROM fx_details",
)
def g5_distinct_ids(fx: Fixtures):
    return coverage.covered(fx.details)


@check(
    "g4_solved_in_both",
    with_views("details") + """
SELECT riddle_id FROM fx_details WHERE run_id = 'run_0' AND riddle_type = 'original' AND correct
INTERSECT SELECT riddle_id FROM fx_details WHERE run_id = 'run_5' AND riddle_type = 'original' AND correct""",
)
def g4_solved_in_both(fx: Fixtures):
    solved = fx.details.where("riddle_type = 'original' AND correct")
    return (
        solved.where("run_id = 'run_0'")
        .select("riddle_id")
        .intersect(solved.where("run_id = 'run_5'").select("riddle_id"))
        .orderBy("riddle_id")
    )


@check(
    "d11_items_by_type",
    with_views("entries") + "\nSELECT type, count(*) AS n_riddles FROM fx_entries WHERE type IS NOT NULL GROUP BY type",
)
def d11_items_by_type(fx: Fixtures):
    return metrics.items_by_type(fx.entries)


CELLS = f"""
every_run AS (SELECT DISTINCT run_id FROM fx_details),
grid AS (SELECT run_id, type FROM every_run CROSS JOIN (SELECT DISTINCT type FROM fx_entries WHERE type IS NOT NULL) t),
cells AS (
  SELECT g.type, g.run_id, {mean('override_mean', 'solved')} AS cor, {mean('accuracy_mean')} AS acc
  FROM grid g LEFT JOIN per_riddle p ON g.run_id = p.run_id AND g.type = p.type GROUP BY ALL)"""


@check(
    "d12_type_run_stats",
    with_views("entries", "details") + f""",{ITEM},{CELLS}
SELECT type, run_id, coalesce({r4('cor')}, -1) AS cor, coalesce({r4('acc')}, -1) AS alt_acc FROM cells""",
)
def d12_type_run_stats(fx: Fixtures):
    cells = metrics.type_run_stats(_per_riddle(fx), fx.entries, fx.runs.select("run_id"))
    return cells.select(
        "type",
        "run_id",
        F.coalesce("cor", F.lit(-1.0)).alias("cor"),
        F.coalesce("alt_acc", F.lit(-1.0)).alias("alt_acc"),
    )


@check(
    "d13_type_rollup",
    with_views("entries", "details") + f""",{ITEM},{CELLS}
SELECT type, {r4(mean(r4('cor')))} AS mean_cor, {r4(mean(r4('acc')))} AS mean_alt_acc, n_riddles
FROM cells JOIN (SELECT type, count(*) AS n_riddles FROM fx_entries GROUP BY type) c USING (type)
WHERE type IN ('constraint_addition', 'meaning_shift', 'context_swap', 'bias_probe')
GROUP BY type, n_riddles""",
)
def d13_type_rollup(fx: Fixtures):
    cells = metrics.type_run_stats(_per_riddle(fx), fx.entries, fx.runs.select("run_id"))
    return metrics.type_rollup(cells, metrics.items_by_type(fx.entries)).select(
        "type", "mean_cor", "mean_alt_acc", "n_riddles"
    )


@check(
    "f7_type_order",
    with_views("entries") + """
SELECT id, CAST(coalesce(list_position(['constraint_addition', 'meaning_shift', 'context_swap', 'bias_probe'], type), 0) AS BIGINT) AS place
FROM fx_entries WHERE type IS NOT NULL""",
)
def f7_type_order(fx: Fixtures):
    return fx.entries.where("type IS NOT NULL").select("id", metrics.type_order().alias("place"))


@check(
    "h19_model_keys",
    with_views("outputs") + """
SELECT DISTINCT run_id, concat(model, '|', coalesce(reasoning_effort, CASE WHEN reasoning_enabled THEN 'on' ELSE 'off' END)) AS model_key
FROM fx_outputs""",
)
def h19_model_keys(fx: Fixtures):
    return fx.outputs.select(
        "run_id", model_key("model", "reasoning_enabled", "reasoning_effort").alias("model_key")
    ).distinct()


# Bootstrap draws as DuckDB SQL, one mixing step per subquery column.
def mixed(x: str, source: str, keep: str) -> str:
    """SELECT keep, u: u is the 32-bit mix of x over source."""
    from evalweave.functions.draws import MASK, MIX_A, MIX_B

    s1 = f"SELECT {keep}, xor(({x}), ({x}) >> 16) AS u FROM {source}"
    s2 = f"SELECT {keep}, (u * {MIX_A}) & {MASK} AS u FROM ({s1})"
    s3 = f"SELECT {keep}, xor(u, u >> 15) AS u FROM ({s2})"
    s4 = f"SELECT {keep}, (u * {MIX_B}) & {MASK} AS u FROM ({s3})"
    return f"SELECT {keep}, xor(u, u >> 15) AS u FROM ({s4})"


def h60(text_sql: str) -> str:
    return f"CAST(concat('0x', substr(md5({text_sql}), 1, 15)) AS BIGINT)"


def keyed(*columns: str) -> str:
    """Keys joined with their lengths, as the seeds take them."""
    return f"concat({', '.join(f'length({c}), chr(58), {c}' for c in columns)})"


def bootstrap_sql(
    scores: str, key: str = "gkey", replicates: int = 2000, seed: int = 42, tag: str = ""
) -> str:
    """CTEs up to ``bounds<tag>(gkey, k, n_total, mean, lo, hi)`` over (gkey, cluster, score)."""
    lo, hi = int(replicates * 0.025) + 1, int(replicates * 0.975) + 1
    t = tag
    spots = f"(SELECT unnest(range((SELECT m FROM longest{t}))) AS i)"
    return f"""
cs{t} AS (SELECT gkey, cluster, CAST(sum(CAST(round(score * 1000000000) AS BIGINT)) AS BIGINT) AS s, count(*) AS n
       FROM {scores} GROUP BY gkey, cluster),
ix{t} AS (SELECT gkey, s, n, row_number() OVER (PARTITION BY gkey ORDER BY {h60('cluster')}, cluster) - 1 AS idx FROM cs{t}),
gr{t} AS (SELECT gkey, count(*) AS k, sum(n) AS n_total, sum(s) AS total,
              CAST(concat('0x', substr(md5(concat('{seed}|', {key})), 1, 8)) AS BIGINT) AS seed FROM cs{t} GROUP BY gkey),
reps{t} AS (SELECT gkey, k, b, (seed + b) & 4294967295 AS x FROM gr{t}, unnest(range({replicates})) t(b) WHERE k >= 5),
bases{t} AS ({mixed('x', f'reps{t}', 'gkey, k, b')}),
longest{t} AS (SELECT max(k) AS m FROM gr{t}),
spots{t} AS ({mixed('i', spots, 'i')}),
starts{t} AS (SELECT gkey, k, b, xor(p.u, q.u) AS x FROM bases{t} p JOIN spots{t} q ON q.i < p.k),
draws{t} AS ({mixed('x', f'starts{t}', 'gkey, k, b')}),
means{t} AS (SELECT d.gkey, b, sum(s) / sum(n) / 1000000000.0 AS m
          FROM draws{t} d JOIN ix{t} x ON d.gkey = x.gkey AND x.idx = d.u % d.k GROUP BY d.gkey, b),
bounds{t} AS (
  SELECT g.gkey, k, n_total, total / n_total / 1000000000.0 AS mean, lo, hi
  FROM gr{t} g LEFT JOIN (SELECT gkey, list_sort(list(m))[{lo}] AS lo, list_sort(list(m))[{hi}] AS hi FROM means{t} GROUP BY gkey) q
    ON g.gkey = q.gkey)"""


@check(
    "d19_clustered_ci",
    with_views("entries", "details") + f""",{ITEM},
scores AS (SELECT run_id AS gkey, cluster, override_mean AS score FROM per_riddle WHERE solved),
{bootstrap_sql('scores', keyed('gkey'))}
SELECT gkey AS run_id, k AS n_clusters, CAST(n_total AS BIGINT) AS n_total, round(mean, 6) AS mean,
       round(lo, 6) AS lo, round(hi, 6) AS hi, round((hi - lo) / 2, 3) AS ci95
FROM bounds""",
)
def d19_clustered_ci(fx: Fixtures):
    scores = _per_riddle(fx).where("original_solved").select(
        "run_id", "cluster", F.col("override_mean").alias("score")
    )
    bounds = bootstrap.bootstrap_bounds(scores, ["run_id"])
    return bounds.select(
        "run_id",
        "n_clusters",
        "n_total",
        rounded("mean"),
        rounded("lo"),
        rounded("hi"),
        F.round((F.col("hi") - F.col("lo")) / 2, 3).alias("ci95"),
    )


@check(
    "d20_plain_ci",
    with_views("details", "entries") + f""",{ITEM},
scores AS (SELECT run_id AS gkey, riddle_id AS cluster, accuracy_mean AS score  FROM per_riddle),
{bootstrap_sql('scores', keyed('gkey'))}
SELECT gkey AS run_id, {r4('(hi - lo) / 2')} AS ci95 FROM bounds""",
)
def d20_plain_ci(fx: Fixtures):
    scores = _per_riddle(fx).select(
        "run_id", "riddle_id", F.col("accuracy_mean").alias("score")
    )
    ci = bootstrap.plain_ci95(scores, ["run_id"], "riddle_id")
    return ci.select("run_id", "ci95")


@check(
    "d21_normal_ci",
    with_views("details") + f"""
SELECT run_id, {r4("1.96 * sqrt(p * (1 - p) / n)")} AS ci95
FROM (SELECT run_id, avg(CAST(correct AS INT)) AS p, count(*) AS n FROM fx_details GROUP BY run_id) q""",
)
def d21_normal_ci(fx: Fixtures):
    share = fx.details.groupBy("run_id").agg(
        F.avg(F.col("correct").cast("int")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return share.select(
        "run_id", bootstrap.normal_half_width(F.col("p"), F.col("n")).alias("ci95")
    )


@check(
    "f6_order_statistics",
    with_views("outputs") + """
SELECT run_id, list_sort(list(z))[CAST(floor(count(*) * 0.025) AS BIGINT) + 1] AS lo,
       list_sort(list(z))[CAST(floor(count(*) * 0.975) AS BIGINT) + 1] AS hi
FROM (SELECT DISTINCT run_id, z FROM fx_outputs) q GROUP BY run_id""",
)
def f6_order_statistics(fx: Fixtures):
    """The pick on sorted values; here over the distinct codes of a run, 30 at most."""
    values = fx.outputs.select("run_id", "z").distinct()
    lists = values.groupBy("run_id").agg(F.array_sort(F.collect_list("z")).alias("v"))
    return lists.select(
        "run_id",
        F.expr("element_at(v, cast(floor(size(v) * 0.025D) as int) + 1)").alias("lo"),
        F.expr("element_at(v, cast(floor(size(v) * 0.975D) as int) + 1)").alias("hi"),
    )


PAIRS = """
ranked AS (SELECT p.*, rank FROM per_riddle p JOIN (
             SELECT row_number() OVER (ORDER BY cor, altered_accuracy DESC, run_ord) AS rank, run_id
             FROM board JOIN tokens USING (run_id)) r USING (run_id) WHERE solved),
shared AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.rank AS rank_a, b.rank AS rank_b, a.riddle_id,
                  a.cluster, a.override_mean - b.override_mean AS score
           FROM ranked a JOIN ranked b ON a.riddle_id = b.riddle_id AND a.rank < b.rank)"""


@check(
    "c14_run_pairs",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD},
r AS (SELECT row_number() OVER (ORDER BY cor, altered_accuracy DESC, run_ord) AS rank, run_id
      FROM board JOIN tokens USING (run_id))
SELECT a.rank AS rank_a, a.run_id AS run_a, b.rank AS rank_b, b.run_id AS run_b FROM r a JOIN r b ON a.rank < b.rank""",
)
def c14_run_pairs(fx: Fixtures):
    return bootstrap.run_pairs(_board(fx))


@check(
    "c15_shared_solved",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD},{PAIRS}
SELECT run_a, run_b, riddle_id, cluster, round(score, 6) AS score FROM shared""",
)
def c15_shared_solved(fx: Fixtures):
    return bootstrap.shared_solved(_per_riddle(fx), _board(fx)).select(
        "run_a", "run_b", "riddle_id", "cluster", rounded("score")
    )


SIGNS = f"""
scores AS (SELECT {keyed('run_a', 'run_b')} AS gkey, cluster, score FROM shared),
{bootstrap_sql('scores', 'gkey')},
signs AS (
  SELECT run_a, rank_a, run_b, rank_b, CASE WHEN hi < 0 THEN 1 WHEN lo > 0 THEN -1 ELSE 0 END AS sign
  FROM (SELECT DISTINCT run_a, rank_a, run_b, rank_b FROM shared) s JOIN bounds ON gkey = {keyed('run_a', 'run_b')})"""


@check(
    "d22_pair_signs",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD},{PAIRS},{SIGNS}
SELECT run_a, run_b, sign FROM signs""",
)
def d22_pair_signs(fx: Fixtures):
    per_riddle, board = _stored(fx)
    return bootstrap.pair_signs(per_riddle, board).select("run_a", "run_b", "sign")


@check(
    "d23_rank_spread",
    with_views("outputs", "details", "entries") + f""",{ITEM},{BOARD},{PAIRS},{SIGNS},
seen AS (SELECT run_b AS run_id, sign FROM signs UNION ALL SELECT run_a, -sign FROM signs)
SELECT run_id, 1 + count(*) FILTER (sign > 0) AS rank_best, 1 + count(*) FILTER (sign >= 0) AS rank_worst
FROM seen GROUP BY run_id""",
)
def d23_rank_spread(fx: Fixtures):
    per_riddle, board = _stored(fx)
    return bootstrap.rank_spread(board, bootstrap.pair_signs(per_riddle, board))
