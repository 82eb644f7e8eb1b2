"""Queries from entries to tasks, outputs, evaluation, leaderboard and type statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.checks.fixtures import Fixtures, with_views
from evalweave.checks.metric_checks import (
    BOARD,
    CELLS,
    ITEM,
    PAIRS,
    SIGNS,
    bootstrap_sql,
    keyed,
    mean,
    r4,
)
from evalweave.checks.registry import check, joined, rounded, text
from evalweave.checks.source_checks import evaluation_of, stored_evaluations
from evalweave.operators import metrics, quality, resume
from evalweave.operators.ordering import union_in_order
from evalweave.plans import evaluation, runs
from evalweave.session import scratch_path
from evalweave.sources import documents

# ── tasks ─────────────────────────────────────────────────────────────

TASKS = """
firsts AS (SELECT arg_min(ord, ord) AS ord FROM fx_entries WHERE original_riddle <> '' GROUP BY original_riddle),
tasks AS (
  SELECT id AS riddle_id, 'altered' AS riddle_type, i AS sample_index, altered_riddle AS riddle_text, ord
  FROM fx_entries, unnest(range(1, 4)) t(i) WHERE altered_riddle <> ''
  UNION ALL
  SELECT id, 'original', 1, original_riddle, ord FROM fx_entries WHERE ord IN (SELECT ord FROM firsts))"""


@check(
    "d25_first_originals",
    with_views("entries") + """
SELECT original_riddle, min(ord) AS ord FROM fx_entries WHERE original_riddle <> '' GROUP BY original_riddle""",
)
def d25_first_originals(fx: Fixtures):
    return runs.first_originals(fx.entries).select("original_riddle", "ord")


@check(
    "j4_task_expansion",
    with_views("entries") + f""",{TASKS}
SELECT riddle_id, riddle_type, CAST(sample_index AS BIGINT) AS sample_index, md5(riddle_text) AS digest FROM tasks""",
)
def j4_task_expansion(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries, num_samples=3, temperature=0.7)
    return tasks.select(
        "riddle_id", "riddle_type", F.col("sample_index").cast("long").alias("sample_index"),
        F.md5("riddle_text").alias("digest"),
    )


@check(
    "h25_sample_sequence",
    with_views("entries") + f""",{TASKS}
SELECT riddle_type, CAST(sample_index AS BIGINT) AS sample_index, count(*) AS n FROM tasks GROUP BY ALL""",
)
def h25_sample_sequence(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries, num_samples=3, temperature=0.7)
    return tasks.groupBy(
        "riddle_type", F.col("sample_index").cast("long").alias("sample_index")
    ).agg(F.count(F.lit(1)).alias("n"))


@check(
    "h26_samples_clamp",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN least(doc_id % 5, 1) ELSE doc_id % 5 END AS n FROM documents",
)
def h26_samples_clamp(fx: Fixtures):
    temperature = F.when(F.col("doc_id") % 2 == 0, 0.0).otherwise(0.7)
    n = runs.effective_samples(F.col("doc_id") % 5, temperature)
    return fx.table("documents").select("doc_id", n.cast("long").alias("n"))


@check(
    "b10_only_altered",
    with_views("entries") + f""",{TASKS}
SELECT riddle_id, count(*) AS n FROM tasks WHERE riddle_type = 'altered' GROUP BY riddle_id""",
)
def b10_only_altered(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries, only="altered", num_samples=3, temperature=0.7)
    return tasks.groupBy("riddle_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "b18_tasks_with_text",
    with_views("outputs") + "\nSELECT ord FROM fx_outputs WHERE model_answer <> ''",
)
def b18_tasks_with_text(fx: Fixtures):
    return quality.with_text(fx.outputs, "model_answer").select("ord")


@check(
    "f5_first_runnable",
    with_views("entries") + f""",{TASKS}
SELECT riddle_id, riddle_type FROM tasks ORDER BY ord, CASE riddle_type WHEN 'original' THEN 0 ELSE 1 END, sample_index LIMIT 1""",
)
def f5_first_runnable(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries)
    return runs.first_runnable(tasks).select("riddle_id", "riddle_type")


DONE = """
done AS (SELECT riddle_id, riddle_type, sample_index FROM fx_outputs WHERE run_id = 'run_2' AND z % 3 <> 1)"""


def _done(fx: Fixtures) -> DataFrame:
    return fx.outputs.where("run_id = 'run_2' AND z % 3 <> 1")


@check(
    "c1_pending_tasks",
    with_views("entries", "outputs") + f""",{TASKS},{DONE}
SELECT riddle_id, riddle_type, CAST(sample_index AS BIGINT) AS sample_index FROM tasks t
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.riddle_id = t.riddle_id AND d.riddle_type = t.riddle_type AND d.sample_index = t.sample_index)""",
)
def c1_pending_tasks(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries, num_samples=3, temperature=0.7)
    return resume.pending_tasks(tasks, _done(fx)).select(
        "riddle_id", "riddle_type", F.col("sample_index").cast("long").alias("sample_index")
    )


@check(
    "x11_build_tasks",
    with_views("entries", "outputs") + f""",{TASKS},{DONE}
SELECT riddle_id, riddle_type, CAST(sample_index AS BIGINT) AS sample_index, md5(riddle_text) AS digest FROM tasks
WHERE (riddle_id, riddle_type, sample_index) NOT IN (SELECT (riddle_id, riddle_type, sample_index) FROM done)""",
)
def x11_build_tasks(fx: Fixtures):
    tasks = runs.build_tasks(fx.entries, num_samples=3, temperature=0.7, done=_done(fx))
    return tasks.select(
        "riddle_id", "riddle_type", F.col("sample_index").cast("long").alias("sample_index"),
        F.md5("riddle_text").alias("digest"),
    )


# ── replies ───────────────────────────────────────────────────────────

PLAIN = "trim(raw, concat(' ', chr(9), chr(10), chr(13)))"
PARSED = f"""
parsed AS (
  SELECT doc_id, raw, error,
         CASE doc_id % 5 WHEN 0 THEN concat(source, ' ', CAST(doc_id AS VARCHAR)) WHEN 1 THEN CAST(doc_id AS VARCHAR)
                         ELSE left({PLAIN}, KEEP) END AS answer,
         CASE doc_id % 5 WHEN 0 THEN 'why' ELSE '' END AS reasoning
  FROM fx_responses)"""


@check(
    "h6_parsed_answers",
    with_views("responses") + "," + PARSED.replace("KEEP", "500") + """
SELECT doc_id, md5(answer) AS answer, reasoning FROM parsed""",
)
def h6_parsed_answers(fx: Fixtures):
    from evalweave.functions.parsing import parsed_answer

    out = parsed_answer("raw")
    return fx.responses.select(
        "doc_id", F.md5(out["answer"]).alias("answer"), out["reasoning"].alias("reasoning")
    )


@check(
    "h7_parsed_sanity_answers",
    with_views("responses") + "," + PARSED.replace("KEEP", "200") + "\nSELECT doc_id, md5(answer) AS answer FROM parsed",
)
def h7_parsed_sanity_answers(fx: Fixtures):
    from evalweave.functions.parsing import parsed_sanity_answer

    return fx.responses.select("doc_id", F.md5(parsed_sanity_answer("raw")).alias("answer"))


VERDICT = """
SELECT doc_id, CAST(doc_id % 5 = 1 AND doc_id % 3 <> 1 AS VARCHAR) AS correct"""


@check(
    "h8_parsed_judgments",
    with_views("responses") + VERDICT + """,
       CAST(doc_id % 5 = 1 AND doc_id % 2 = 0 AS VARCHAR) AS gave_original, 'false' AS competing FROM fx_responses""",
)
def h8_parsed_judgments(fx: Fixtures):
    from evalweave.functions.parsing import parsed_judgment

    out = parsed_judgment("raw")
    return fx.responses.select(
        "doc_id", *[text(out[c], c) for c in ("correct", "gave_original", "competing")]
    )


@check("h9_parsed_sanity_judgments", with_views("responses") + VERDICT + " FROM fx_responses")
def h9_parsed_sanity_judgments(fx: Fixtures):
    from evalweave.functions.parsing import parsed_sanity_judgment

    return fx.responses.select("doc_id", text(parsed_sanity_judgment("raw")["correct"], "correct"))


@check(
    "h15_truthiness",
    with_views("responses") + """
SELECT doc_id, CAST(coalesce(json_extract(j, '$.correct')::VARCHAR NOT IN ('0', '""', 'false', 'null', '[]', '{}'), FALSE) AS VARCHAR) AS correct,
       CAST(coalesce(json_array_length(j, '$.gave_original') > 0, FALSE) AS VARCHAR) AS gave_original
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN raw END AS j FROM fx_responses) q""",
)
def h15_truthiness(fx: Fixtures):
    from evalweave.functions.parsing import json_object, member_true

    obj = json_object("raw")
    return fx.responses.withColumn("raw", F.when(F.col("doc_id") % 5 == 1, F.col("raw"))).select(
        "doc_id", text(member_true(obj, "correct"), "correct"),
        text(member_true(obj, "gave_original"), "gave_original"),
    )


@check(
    "h4_strip_fences",
    with_views("responses") + f"""
SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN raw[9:len(raw) - 4] ELSE {PLAIN} END) AS digest FROM fx_responses""",
)
def h4_strip_fences(fx: Fixtures):
    from evalweave.functions.parsing import strip_fences

    return fx.responses.select("doc_id", F.md5(strip_fences("raw")).alias("digest"))


def _replies(fx: Fixtures) -> DataFrame:
    return fx.responses.select(
        F.concat(F.lit("run_"), (F.col("doc_id") % 3).cast("string")).alias("run_id"),
        "ord",
        F.col("doc_id").cast("string").alias("riddle_id"),
        F.lit("altered").alias("riddle_type"),
        F.lit(1).alias("sample_index"),
        F.col("source").alias("riddle_text"),
        F.col("raw").alias("raw_response"),
        "error",
        F.lit("Org/Model-A").alias("model"),
        F.lit("acme").alias("provider"),
        F.lit(None).cast("string").alias("quantization"),
        F.lit(0.7).alias("temperature"),
        F.lit(True).alias("reasoning_enabled"),
        F.lit("high").alias("reasoning_effort"),
        F.length("raw").cast("long").alias("input_tokens"),
        F.lit(7).cast("long").alias("output_tokens"),
    )


RECORDS = (
    with_views("responses")
    + ","
    + PARSED.replace("KEEP", "500")
    + """
SELECT CAST(doc_id AS VARCHAR) AS riddle_id, 'org/model-a' AS model,
       CASE WHEN error IS NOT NULL OR raw = '' THEN 'ERROR' ELSE md5(answer) END AS model_answer,
       CASE WHEN error IS NOT NULL THEN error WHEN raw = '' THEN 'Empty response' ELSE reasoning END AS model_reasoning,
       CASE WHEN error IS NULL THEN 7 ELSE -1 END AS output_tokens, '2024-03-01T12:30:00' AS timestamp
FROM parsed"""
)


def _records(fx: Fixtures) -> DataFrame:
    stamp = F.from_utc_timestamp(F.lit("2024-03-01 12:30:00"), F.current_timezone())
    answer = F.col("model_answer")
    return runs.ingest_outputs(_replies(fx), stamp).select(
        "riddle_id",
        "model",
        F.when(answer == "ERROR", answer).otherwise(F.md5(answer)).alias("model_answer"),
        "model_reasoning",
        F.coalesce("output_tokens", F.lit(-1)).alias("output_tokens"),
        "timestamp",
    )


@check("x12_ingest_outputs", RECORDS)
def x12_ingest_outputs(fx: Fixtures):
    return _records(fx)


@check("b14_output_projection", f"SELECT riddle_id, model, timestamp FROM ({RECORDS}) q")
def b14_output_projection(fx: Fixtures):
    return _records(fx).select("riddle_id", "model", "timestamp")


@check(
    "b15_error_rows",
    f"SELECT riddle_id, model_reasoning, output_tokens FROM ({RECORDS}) q WHERE model_answer = 'ERROR'",
)
def b15_error_rows(fx: Fixtures):
    return _records(fx).where("model_answer = 'ERROR'").select(
        "riddle_id", "model_reasoning", "output_tokens"
    )


# ── judging and evaluation ────────────────────────────────────────────


def _judged(fx: Fixtures) -> DataFrame:
    verdict = F.struct("correct", "gave_original", "competing").alias("judgment")
    return fx.judgments.select("run_id", "riddle_id", "riddle_type", "sample_index", "ord", verdict)


@check(
    "c2_pending_judgments",
    with_views("outputs") + "\nSELECT ord FROM fx_outputs WHERE z = 28",
)
def c2_pending_judgments(fx: Fixtures):
    return resume.pending_judgments(fx.outputs, _judged(fx)).select("ord")


@check(
    "c7_outputs_with_entries",
    with_views("outputs", "entries") + """
SELECT o.ord, o.riddle_id, e.original_answer FROM fx_outputs o JOIN fx_entries e ON o.riddle_id = e.id""",
)
def c7_outputs_with_entries(fx: Fixtures):
    return resume.with_entries(fx.outputs, fx.entries, ["original_answer"]).select(
        "ord", "riddle_id", "original_answer"
    )


LATEST = """
latest AS (SELECT run_id, riddle_id, riddle_type, sample_index, arg_max(correct, ord) AS correct,
                  arg_max(gave_original, ord) AS gave, arg_max(competing, ord) AS competing
           FROM fx_judgments GROUP BY ALL),
fx_details AS (
  SELECT o.ord, o.run_id, o.riddle_id, o.riddle_type, o.sample_index, o.model_answer,
         coalesce(l.correct, FALSE) AS correct,
         CASE WHEN o.riddle_type = 'altered' THEN coalesce(l.gave, FALSE) END AS gave_original_answer,
         CASE WHEN o.riddle_type = 'altered' THEN e.original_answer END AS original_answer
  FROM fx_outputs o JOIN fx_entries e ON o.riddle_id = e.id
  LEFT JOIN latest l USING (run_id, riddle_id, riddle_type, sample_index))"""


@check(
    "c8_judgment_left_join",
    with_views("outputs", "judgments") + """
SELECT o.ord, CAST(coalesce(l.correct, FALSE) AS VARCHAR) AS correct, CAST(coalesce(l.competing, FALSE) AS VARCHAR) AS competing
FROM fx_outputs o LEFT JOIN (
  SELECT run_id, riddle_id, riddle_type, sample_index, arg_max(correct, ord) AS correct, arg_max(competing, ord) AS competing
  FROM fx_judgments GROUP BY ALL) l USING (run_id, riddle_id, riddle_type, sample_index)""",
)
def c8_judgment_left_join(fx: Fixtures):
    return resume.with_judgments(fx.outputs, _judged(fx)).select(
        "ord", text("correct"), text("competing")
    )


@check(
    "b16_detail_projection",
    with_views("outputs", "judgments", "entries") + f""",{LATEST}
SELECT ord, run_id, riddle_id, CAST(correct AS VARCHAR) AS correct,
       coalesce(CAST(gave_original_answer AS VARCHAR), '-') AS gave_original_answer,
       coalesce(original_answer, '-') AS original_answer FROM fx_details""",
)
def b16_detail_projection(fx: Fixtures):
    return evaluation_of(fx).details.select(
        "ord", "run_id", "riddle_id", text("correct"),
        F.coalesce(text("gave_original_answer"), F.lit("-")).alias("gave_original_answer"),
        F.coalesce("original_answer", F.lit("-")).alias("original_answer"),
    )


@check(
    "b11_run_metadata",
    with_views("outputs") + """
SELECT run_id, arg_min(model, ord) AS model, 'acme' AS provider,
       CAST(bool_or(reasoning_enabled) AS VARCHAR) AS reasoning_enabled, coalesce(max(reasoning_effort), '-') AS reasoning_effort
FROM fx_outputs GROUP BY run_id""",
)
def b11_run_metadata(fx: Fixtures):
    return quality.checked_run_metadata(fx.outputs).select(
        "run_id", "model", "provider", text("reasoning_enabled"),
        F.coalesce("reasoning_effort", F.lit("-")).alias("reasoning_effort"),
    )


@check(
    "h20_judge_prompts",
    with_views("outputs", "entries") + """
SELECT o.ord, concat('Q: ', riddle_text, ' A: ', model_answer, ' accept ', to_json([CASE WHEN riddle_type = 'original' THEN original_answer ELSE altered_answer END]),
              ' original ', to_json([original_answer]), ' competing []') AS prompt
FROM fx_outputs o JOIN fx_entries e ON o.riddle_id = e.id WHERE z = 28""",
)
def h20_judge_prompts(fx: Fixtures):
    none = F.lit(None).cast("array<string>")
    entries = fx.entries.withColumns(
        {
            "original_accepted_answers": none,
            "altered_accepted_answers": none,
            "altered_competing_answers": none,
        }
    )
    prompts = evaluation.judge_prompts(
        fx.outputs, _judged(fx), entries,
        "Q: {riddle} A: {model_answer} accept {accepted} original {original} competing {competing}",
    )
    return prompts.select("ord", "prompt")


@check(
    "h21_judge_targets",
    with_views("outputs", "entries") + """
SELECT o.ord, CASE WHEN riddle_type = 'original' THEN original_answer ELSE concat(altered_answer, '|more') END AS targets
FROM fx_outputs o JOIN fx_entries e ON o.riddle_id = e.id""",
)
def h21_judge_targets(fx: Fixtures):
    from evalweave.functions.answers import judge_targets

    entries = fx.entries.withColumns(
        {
            "original_accepted_answers": F.lit(None).cast("array<string>"),
            "altered_accepted_answers": F.array(F.col("altered_answer"), F.lit("more")),
        }
    )
    columns = ["original_answer", "altered_answer", "original_accepted_answers", "altered_accepted_answers"]
    return resume.with_entries(fx.outputs, entries, columns).select(
        "ord", joined(judge_targets("riddle_type"), "targets")
    )


REP_ROWS = """
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, riddle_id, riddle_type
          ORDER BY CASE WHEN sample_index = 1 THEN 0 ELSE 1 END, ord) AS rn FROM fx_details) x WHERE rn = 1),
summary AS (
  SELECT run_id, count(*) FILTER (riddle_type = 'original') AS original_total,
         count(*) FILTER (riddle_type = 'original' AND correct) AS original_correct,
         count(*) FILTER (riddle_type = 'altered') AS altered_total,
         count(*) FILTER (riddle_type = 'altered' AND correct) AS altered_correct,
         count(*) FILTER (riddle_type = 'altered' AND gave_original_answer) AS overridden
  FROM rep GROUP BY run_id),
cond AS (
  SELECT run_id, count(*) AS k, sum(n_override) AS s, MEAN AS rate FROM item
  WHERE n > 0 AND n_original_correct > 0 GROUP BY run_id)""".replace("MEAN", mean("n_override / n"))


@check(
    "x13_evaluate_runs",
    with_views("outputs", "judgments", "entries") + f""",{LATEST},{ITEM},{REP_ROWS},
tokens AS (SELECT run_id, sum(input_tokens) AS tin, sum(output_tokens) AS tout FROM fx_outputs GROUP BY run_id)
SELECT run_id, original_total, original_correct, {r4('original_correct / original_total')} AS original_accuracy,
       altered_total, altered_correct, {r4('altered_correct / altered_total')} AS altered_accuracy,
       {r4('overridden / altered_total')} AS pattern_override_rate, k AS conditioned_override_total,
       CAST(s AS BIGINT) AS conditioned_override_count, {r4('rate')} AS conditioned_override_rate,
       CAST(tin AS BIGINT) AS total_input_tokens, CAST(tout AS BIGINT) AS total_output_tokens
FROM summary JOIN cond USING (run_id) JOIN tokens USING (run_id)""",
)
def x13_evaluate_runs(fx: Fixtures):
    return evaluation_of(fx).summary.select(
        "run_id", "original_total", "original_correct", "original_accuracy", "altered_total",
        "altered_correct", "altered_accuracy", "pattern_override_rate",
        "conditioned_override_total", "conditioned_override_count", "conditioned_override_rate",
        "total_input_tokens", "total_output_tokens",
    )


@check(
    "c9_original_solved_join",
    with_views("outputs", "judgments", "entries") + f""",{LATEST},{ITEM}
SELECT run_id, riddle_id, CAST(n_original_correct > 0 AS VARCHAR) AS original_solved FROM item WHERE n > 0""",
)
def c9_original_solved_join(fx: Fixtures):
    return metrics.per_riddle_stats(evaluation_of(fx).details).select(
        "run_id", "riddle_id", text("original_solved")
    )


@check(
    "c10_cluster_lookup",
    with_views("outputs", "entries") + """
SELECT DISTINCT run_id, riddle_id, CASE WHEN e.id IS NULL THEN riddle_id ELSE original_riddle END AS cluster
FROM fx_outputs o LEFT JOIN fx_entries e ON o.riddle_id = e.id WHERE riddle_type = 'altered'""",
)
def c10_cluster_lookup(fx: Fixtures):
    """Over all outputs, unknown items included, so that the fallback occurs."""
    samples = fx.outputs.withColumns(
        {"correct": F.col("correct_flag"), "gave_original_answer": F.col("gave_flag")}
    )
    return metrics.per_riddle_stats(samples, fx.entries).select("run_id", "riddle_id", "cluster")


@check(
    "c11_typed_items",
    with_views("details", "entries") + """
SELECT DISTINCT run_id, riddle_id, type FROM fx_details d JOIN fx_entries e ON d.riddle_id = e.id
WHERE riddle_type = 'altered' AND type IS NOT NULL""",
)
def c11_typed_items(fx: Fixtures):
    typed = fx.entries.where(F.coalesce("type", F.lit("")) != "").select(
        F.col("id").alias("riddle_id"), "type"
    )
    return metrics.per_riddle_stats(fx.details).join(typed, "riddle_id").select(
        "run_id", "riddle_id", "type"
    )


COMPLETE = """
expected AS (
  SELECT 'altered' AS riddle_type, id AS riddle_id FROM fx_entries
  UNION
  SELECT 'original', arg_min(id, ord) FROM fx_entries WHERE original_riddle <> '' GROUP BY original_riddle),
full_runs AS (
  SELECT run_id FROM (SELECT DISTINCT run_id, riddle_type, riddle_id FROM all_details) JOIN expected USING (riddle_type, riddle_id)
  GROUP BY run_id HAVING count(*) = (SELECT count(*) FROM expected)),
fx_details AS (SELECT * FROM all_details WHERE run_id IN (SELECT run_id FROM full_runs))"""

BOARD_ALL = (
    with_views("outputs", "judgments", "entries")
    + ","
    + LATEST.replace("fx_details AS", "all_details AS")
    + ","
    + COMPLETE
    + ","
    + ITEM
    + ","
    + BOARD
)


def _metric_key(name: str) -> str:
    return keyed(f"'{name}'", "run_id")


def _interval(name: str, score: str, where: str) -> str:
    scores = (
        f"\nscores_{name} AS (SELECT {_metric_key(name)} AS gkey, cluster, {score} AS score"
        f" FROM per_riddle WHERE {where}),"
    )
    return scores + bootstrap_sql(f"scores_{name}", tag=f"_{name}")


LEADERBOARD = (
    BOARD_ALL
    + ","
    + _interval("override", "override_mean", "solved")
    + ","
    + _interval("accuracy", "accuracy_mean", "TRUE")
    + ","
    + PAIRS
    + ","
    + SIGNS
    + f""",
seen AS (SELECT run_b AS run_id, sign FROM signs UNION ALL SELECT run_a, -sign FROM signs),
spread AS (SELECT run_id, 1 + count(*) FILTER (sign > 0) AS rank_best, 1 + count(*) FILTER (sign >= 0) AS rank_worst
           FROM seen GROUP BY run_id)
SELECT row_number() OVER (ORDER BY cor, altered_accuracy DESC, run_ord) AS rank, run_id, rank_best, rank_worst,
       round(cor, 6) AS conditioned_override_rate, round(altered_accuracy, 6) AS altered_accuracy,
       {r4('(o.hi - o.lo) / 2')} AS conditioned_override_ci95, {r4('(a.hi - a.lo) / 2')} AS altered_accuracy_ci95,
       CAST(override_samples AS BIGINT) AS conditioned_override_total, n_items AS unique_altered_riddles,
       n_solved AS conditioned_unique_altered_riddles
FROM board JOIN tokens USING (run_id) JOIN spread USING (run_id)
JOIN bounds_override o ON o.gkey = {_metric_key('override')} JOIN bounds_accuracy a ON a.gkey = {_metric_key('accuracy')}"""
)


@check("x14_leaderboard", LEADERBOARD)
def x14_leaderboard(fx: Fixtures):
    return _board(evaluation.leaderboard(evaluation_of(fx), fx.entries))


@check("x14_from_documents", LEADERBOARD)
def x14_from_documents(fx: Fixtures):
    """As ``x14_leaderboard``, from stored documents, several per run."""
    found = evaluation.evaluation_from_documents(stored_evaluations(fx))
    return _board(evaluation.leaderboard(found, fx.entries))


def _board(board: DataFrame) -> DataFrame:
    return board.select(
        "rank", "run_id", "rank_best", "rank_worst", rounded("conditioned_override_rate"),
        rounded("altered_accuracy"), "conditioned_override_ci95",
        "altered_accuracy_ci95", "conditioned_override_total",
        "unique_altered_riddles", "conditioned_unique_altered_riddles",
    )


LAST_OF_KEY = """
keys AS (SELECT run_id, min(ord) AS run_ord, concat(min(model), '|', coalesce(max(reasoning_effort), CASE WHEN bool_or(reasoning_enabled) THEN 'on' ELSE 'off' END)) AS model_key
         FROM fx_outputs GROUP BY run_id),
kept AS (SELECT arg_max(run_id, run_ord) AS run_id, model_key FROM keys GROUP BY model_key)"""


@check(
    "x15_type_stats",
    with_views("outputs", "judgments", "entries") + f""",{LATEST},{ITEM},{CELLS},{LAST_OF_KEY}
SELECT type, {r4(mean(r4('cor')))} AS mean_cor, {r4(mean(r4('acc')))} AS mean_alt_acc, n_riddles
FROM cells JOIN kept USING (run_id) JOIN (SELECT type, count(*) AS n_riddles FROM fx_entries GROUP BY type) c USING (type)
GROUP BY type, n_riddles""",
)
def x15_type_stats(fx: Fixtures):
    types, _ = evaluation.type_stats(evaluation_of(fx), fx.entries)
    return types


@check(
    "x15_type_cells",
    with_views("outputs", "judgments", "entries") + f""",{LATEST},{ITEM},{CELLS},{LAST_OF_KEY}
SELECT type, model_key, coalesce({r4('cor')}, -1) AS cor, coalesce({r4('acc')}, -1) AS alt_acc FROM cells JOIN kept USING (run_id)""",
)
def x15_type_cells(fx: Fixtures):
    _, cells = evaluation.type_stats(evaluation_of(fx), fx.entries)
    return cells.select(
        "type", "model_key", F.coalesce("cor", F.lit(-1.0)).alias("cor"),
        F.coalesce("alt_acc", F.lit(-1.0)).alias("alt_acc"),
    )


def _digits(value: str, digits: int = 1) -> str:
    return f"format('{{:.{digits}f}}', {value})"


def _percent(value: str) -> str:
    return f"concat({_digits(f'CAST({value} AS DOUBLE) * 100')}, '%')"


@check(
    "x15_type_document",
    with_views("outputs", "judgments", "entries") + f""",{LATEST},{ITEM},{CELLS},{LAST_OF_KEY},
shown AS (SELECT type, model_key, {r4('cor')} AS cor, {r4('acc')} AS acc, split_part(model_key, '|', 1) AS model,
                 run_id IN ('run_3', 'run_4', 'run_5') AS reasoning FROM cells JOIN kept USING (run_id)),
rolled AS (SELECT type, {r4(mean('cor'))} AS mean_cor, {r4(mean('acc'))} AS mean_alt_acc FROM shown GROUP BY type)
SELECT '2024-01-01T00:00:00Z' AS generated_at, type, coalesce(mean_cor, -1) AS mean_cor, coalesce(mean_alt_acc, -1) AS mean_alt_acc,
       n_riddles, model_key, model, CAST(reasoning AS VARCHAR) AS reasoning_enabled,
       CASE WHEN reasoning THEN 'high' ELSE '-' END AS reasoning_effort, coalesce(cor, -1) AS cor, coalesce(acc, -1) AS alt_acc
FROM shown JOIN rolled USING (type) JOIN (SELECT type, count(*) AS n_riddles FROM fx_entries GROUP BY type) c USING (type)""",
)
def x15_type_document(fx: Fixtures):
    """The type document, written and read again, one row per type and model."""
    types, cells = evaluation.type_stats(evaluation_of(fx), fx.entries)
    path = scratch_path(fx.spark, "types")
    utc = F.from_utc_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.current_timezone())
    documents.write_document(evaluation.type_document(types, cells, utc), path)
    stored = documents.scan_type_document(fx.spark, path)
    rows = stored.select("*", F.explode("per_model").alias("model_key", "m")).drop("per_model")
    none = F.lit(-1.0)
    return rows.select(
        "generated_at", "type", F.coalesce("mean_cor", none).alias("mean_cor"),
        F.coalesce("mean_alt_acc", none).alias("mean_alt_acc"), "n_riddles", "model_key", "m.model",
        text("m.reasoning_enabled", "reasoning_enabled"),
        F.coalesce("m.reasoning_effort", F.lit("-")).alias("reasoning_effort"),
        F.coalesce("m.cor", none).alias("cor"), F.coalesce("m.alt_acc", none).alias("alt_acc"),
    )


DISPLAYED = f""", rates AS (
  SELECT run_id, {r4("count(*) FILTER (riddle_type = 'original' AND correct) / count(*) FILTER (riddle_type = 'original')")} AS original_rate,
         {r4("count(*) FILTER (riddle_type = 'altered' AND gave_original_answer) / count(*) FILTER (riddle_type = 'altered')")} AS pattern_rate
  FROM rep GROUP BY run_id)
SELECT row_number() OVER (ORDER BY cor, altered_accuracy DESC, run_ord) AS rank,
       concat('[', rank_best, '–', rank_worst, ']') AS rank_spread, concat('org/model-', CAST(substr(run_id, 5) AS INT) % 4) AS model,
       CASE WHEN run_id IN ('run_3', 'run_4', 'run_5') THEN 'on' ELSE 'off' END AS reasoning,
       CASE WHEN run_id IN ('run_3', 'run_4', 'run_5') THEN 'high' ELSE '-' END AS effort,
       {_percent('original_rate')} AS original_accuracy, {_percent('altered_accuracy')} AS altered_accuracy,
       {_percent('cor')} AS conditioned_override, concat('+/-', {_percent(r4('(o.hi - o.lo) / 2'))}) AS ci95,
       {_percent('pattern_rate')} AS override_rate, {_digits('CAST(tout AS DOUBLE) / samples')} AS tokens_per_riddle,
       {_digits('avg_samples', 2)} AS samples_per_riddle
FROM board JOIN tokens USING (run_id) JOIN rates USING (run_id) JOIN spread USING (run_id)
JOIN bounds_override o ON o.gkey = {_metric_key('override')}"""


@check("b17_display_columns", LEADERBOARD[: LEADERBOARD.rindex("SELECT row_number()")] + DISPLAYED)
def b17_display_columns(fx: Fixtures):
    return quality.display_columns(evaluation.leaderboard(evaluation_of(fx), fx.entries))


@check(
    "g1_union_of_sets",
    with_views("entries") + """
SELECT row_number() OVER (ORDER BY CASE set_name WHEN 'auxiliary' THEN 0 ELSE 1 END, ord) AS place, id FROM fx_entries""",
)
def g1_union_of_sets(fx: Fixtures):
    from evalweave.operators.ordering import global_rank

    entries = fx.entries.select("ord", "id", "set_name")
    both = union_in_order(
        entries.where("set_name = 'auxiliary'"), entries.where("set_name = 'fixed'")
    )
    return global_rank(both, "ord", name="place").select("place", "id")
