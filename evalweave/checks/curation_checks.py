"""Queries for the curation stages: sanity, generation, validation, review, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.checks.fixtures import Fixtures, with_views
from evalweave.checks.metric_checks import mean, r4
from evalweave.checks.registry import check, joined, text
from evalweave.functions import text as txt
from evalweave.functions.prompts import render
from evalweave.operators import duplicates, metrics, ordering, quality, resume, selection
from evalweave.operators.components import connected_components
from evalweave.operators.scoring import score_prompts
from evalweave.plans import generation, promotion, sanity, validation
from evalweave.session import scratch_path
from evalweave.sources import documents
from evalweave.sources.jsonl import struct_of

# ── sanity check ──────────────────────────────────────────────────────

VERDICTS = """
verdict AS (  -- last judgment per (solver, item); none where the amount is a multiple of 11
  SELECT solver, riddle_idx, arg_max(cents % 3 = 0 AND model_answer <> '', ord) AS correct
  FROM fx_sanity_answers WHERE cents % 11 <> 0 GROUP BY solver, riddle_idx),
result AS (
  SELECT a.solver, a.solver_ord, a.riddle_idx, coalesce(v.correct, FALSE) AS correct
  FROM (SELECT DISTINCT solver, solver_ord, riddle_idx FROM fx_sanity_answers) a
  LEFT JOIN verdict v USING (solver, riddle_idx))"""


def sanity_inputs(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    answers = fx.sanity_answers
    correct = (F.col("cents") % 3 == 0) & (F.col("model_answer") != "")
    judged = answers.where("cents % 11 <> 0").select(
        "solver", "riddle_idx", "ord", F.struct(correct.alias("correct")).alias("judgment")
    )
    return answers, judged


@check(
    "b7_empty_answers",
    with_views("sanity_answers") + """
SELECT ord, CASE WHEN model_answer = '' THEN 'false' ELSE 'ask' END AS verdict FROM fx_sanity_answers""",
)
def b7_empty_answers(fx: Fixtures):
    ask, done = quality.split_empty_answers(fx.sanity_answers)
    return ask.select("ord", F.lit("ask").alias("verdict")).union(
        done.select("ord", text("judgment.correct", "verdict"))
    )


@check(
    "c3_pending_sanity",
    with_views("sanity_answers") + """
SELECT ord FROM fx_sanity_answers a WHERE NOT EXISTS (
  SELECT 1 FROM fx_sanity_answers j WHERE j.cents % 11 <> 0 AND j.ord % 2 = 0 AND j.solver = a.solver AND j.riddle_idx = a.riddle_idx)""",
)
def c3_pending_sanity(fx: Fixtures):
    answers, judged = sanity_inputs(fx)
    return resume.pending_sanity(answers, judged.where("ord % 2 = 0")).select("ord")


@check(
    "d6_solver_accuracy",
    with_views("sanity_answers") + f""",{VERDICTS}
SELECT solver, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, count(*) AS total,
       {r4('count(*) FILTER (correct) / count(*)')} AS accuracy
FROM result GROUP BY solver""",
)
def d6_solver_accuracy(fx: Fixtures):
    return metrics.sanity_solver_accuracy(sanity.judged_answers(*sanity_inputs(fx)))


@check(
    "d6_macro_accuracy",
    with_views("sanity_answers") + f""",{VERDICTS}
SELECT {r4(mean('accuracy'))} AS mean_accuracy
FROM (SELECT {r4('count(*) FILTER (correct) / count(*)')} AS accuracy FROM result GROUP BY solver) s""",
)
def d6_macro_accuracy(fx: Fixtures):
    return metrics.sanity_macro_accuracy(d6_solver_accuracy(fx))


ITEMS = f"""
items AS (
  SELECT r.riddle_idx, m.riddle, m.expected_answer, {r4('count(*) FILTER (correct) / count(*)')} AS mean_accuracy,
         count(*) AS models_evaluated,
         coalesce(array_to_string(list(solver ORDER BY solver_ord) FILTER (correct), '|'), '') AS models_correct
  FROM result r JOIN (SELECT riddle_idx, arg_min(riddle, ord) AS riddle, arg_min(expected_answer, ord) AS expected_answer
                      FROM fx_sanity_answers GROUP BY riddle_idx) m USING (riddle_idx)
  GROUP BY r.riddle_idx, m.riddle, m.expected_answer)"""


@check(
    "d7_item_accuracy",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS} SELECT * FROM items""",
)
def d7_item_accuracy(fx: Fixtures):
    items = sanity.sanity_items(*sanity_inputs(fx))
    return items.select(
        "riddle_idx", "riddle", "expected_answer", "mean_accuracy", "models_evaluated",
        joined("models_correct", "models_correct"),
    )


@check(
    "d8_common_count",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS}
SELECT count(*) FILTER (mean_accuracy >= 0.3) AS common FROM items""",
)
def d8_common_count(fx: Fixtures):
    return metrics.common_count(sanity.sanity_items(*sanity_inputs(fx)), 0.3)


@check(
    "b5_common_items",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS}
SELECT riddle_idx FROM items WHERE coalesce(mean_accuracy, 0) >= 0.3""",
)
def b5_common_items(fx: Fixtures):
    return resume.common_items(sanity.sanity_items(*sanity_inputs(fx)), 0.3).select("riddle_idx")


@check(
    "f2_hardest_items",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS}
SELECT riddle_idx, mean_accuracy FROM items ORDER BY mean_accuracy, riddle_idx LIMIT 10""",
)
def f2_hardest_items(fx: Fixtures):
    items = sanity.sanity_items(*sanity_inputs(fx))
    return metrics.hardest(items).select("riddle_idx", "mean_accuracy")


@check(
    "x1_sanity_report",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS}
SELECT 'solver' AS part, solver AS name, {r4('count(*) FILTER (correct) / count(*)')} AS accuracy FROM result GROUP BY solver
UNION ALL SELECT 'item', CAST(riddle_idx AS VARCHAR), mean_accuracy FROM items
UNION ALL SELECT 'overall', 'common', CAST(count(*) FILTER (mean_accuracy >= 0.6) AS DOUBLE) FROM items""",
)
def x1_sanity_report(fx: Fixtures):
    report = sanity.sanity_report(*sanity_inputs(fx))
    return (
        report["solvers"].select(F.lit("solver").alias("part"), F.col("solver").alias("name"), "accuracy")
        .union(report["items"].select(F.lit("item"), F.col("riddle_idx").cast("string"), "mean_accuracy"))
        .union(report["overall"].select(F.lit("overall"), F.lit("common"), F.col("common").cast("double")))
    )


@check(
    "x1_sanity_document",
    with_views("sanity_answers") + f""",{VERDICTS},{ITEMS},
solvers AS (SELECT solver, count(*) FILTER (correct) AS correct, count(*) AS total,
                   {r4('count(*) FILTER (correct) / count(*)')} AS accuracy FROM result GROUP BY solver)
SELECT 'solver' AS part, solver AS name, accuracy, concat(correct, '/', total) AS detail FROM solvers
UNION ALL SELECT 'item', CAST(riddle_idx AS VARCHAR), mean_accuracy,
       concat_ws('|', riddle, expected_answer, CAST(models_evaluated AS VARCHAR), models_correct) FROM items
UNION ALL SELECT 'mean', 'acme/judge', {r4(mean('accuracy'))}, '' FROM solvers""",
)
def x1_sanity_document(fx: Fixtures):
    """The report as stored documents of 30 items, read again: judge, models, mean and items."""
    path = scratch_path(fx.spark, "sanity_documents")
    report = sanity.sanity_report(*sanity_inputs(fx), judge="acme/judge")
    documents.write_documents(sanity.sanity_documents(report, max_items=30), path)
    heads = fx.spark.read.schema(struct_of(schemas.SANITY_RESULTS)).json(path).select(
        "judge", "models", "mean_accuracy"
    ).distinct()
    models = heads.select(F.inline("models")).select(
        F.lit("solver").alias("part"), F.col("solver").alias("name"), "accuracy",
        F.concat_ws("/", "correct", "total").alias("detail"),
    )
    items = documents.scan_sanity_results(fx.spark, path).select(
        F.lit("item"), F.col("riddle_idx").cast("string"), "mean_accuracy",
        F.concat_ws(
            "|", "riddle", "expected_answer", F.col("models_evaluated").cast("string"),
            F.array_join("models_correct", "|"),
        ),
    )
    return models.union(items).union(heads.select(F.lit("mean"), "judge", "mean_accuracy", F.lit("")))


# ── generation ────────────────────────────────────────────────────────


def _source(fx: Fixtures) -> DataFrame:
    """One source item per document; its text is the original of the pool items."""
    return fx.table("documents").select(
        F.col("doc_id").alias("riddle_idx"),
        F.concat(F.lit(" ORIG_"), F.col("doc_id").cast("string")).alias("riddle"),
        F.col("lang").alias("answer"),
    )


USES = """
uses AS (SELECT lower(trim(original_riddle)) AS k, count(*) AS n FROM fx_pool
         WHERE trim(original_riddle) <> '' GROUP BY 1),
source AS (SELECT doc_id AS riddle_idx, concat('orig_', CAST(doc_id AS VARCHAR)) AS k, lang FROM documents)"""


@check(
    "d14_representation_counts",
    with_views("pool") + f""",{USES} SELECT k AS original_key, n FROM uses""",
)
def d14_representation_counts(fx: Fixtures):
    return resume.representation_counts(fx.pool)


@check(
    "c12_representation_join",
    with_views("pool") + f""",{USES}
SELECT riddle_idx, coalesce(n, 0) AS n FROM source LEFT JOIN uses USING (k)""",
)
def c12_representation_join(fx: Fixtures):
    return resume.with_representation(_source(fx), fx.pool).select("riddle_idx", "n")


def _sanity_scores(fx: Fixtures) -> DataFrame:
    """Accuracy per source item from the labels, where there is one."""
    return fx.table("labels").select(
        F.col("doc_id").alias("riddle_idx"),
        F.when(F.col("doc_id") % 13 != 0, F.col("quality") * 0.5 + 0.2).alias("mean_accuracy"),
    )


@check(
    "c6_common_semi_join",
    "SELECT doc_id AS riddle_idx FROM labels WHERE doc_id % 13 <> 0 AND quality * 0.5 + 0.2 >= 0.6",
)
def c6_common_semi_join(fx: Fixtures):
    return resume.only_common(_source(fx), _sanity_scores(fx)).select("riddle_idx")


PICKS = """
ranked AS (
  SELECT riddle_idx, coalesce(n, 0) AS n, lang,
         row_number() OVER (ORDER BY coalesce(n, 0),
           CAST(concat('0x', substr(md5(concat('0|', CAST(riddle_idx AS VARCHAR))), 1, 15)) AS BIGINT) >> 28, riddle_idx) - 1 AS p
  FROM source LEFT JOIN uses USING (k) {where}),
picks AS (SELECT call_idx, riddle_idx, lang FROM (SELECT unnest(range(2500)) AS call_idx) c
          JOIN ranked ON p = call_idx % (SELECT count(*) FROM ranked))"""


@check(
    "f4_least_represented",
    with_views("pool") + f""",{USES},{PICKS.format(where='')} SELECT call_idx, riddle_idx FROM picks""",
)
def f4_least_represented(fx: Fixtures):
    return selection.least_represented(_source(fx), fx.pool, 2500).select("call_idx", "riddle_idx")


COMMON_ONLY = "WHERE riddle_idx IN (SELECT doc_id FROM labels WHERE doc_id % 13 <> 0 AND quality * 0.5 + 0.2 >= 0.6)"


@check(
    "x2_plan_generation",
    with_views("pool") + f""",{USES},{PICKS.format(where=COMMON_ONLY)}
SELECT call_idx, riddle_idx, concat('Vary  ORIG_', CAST(riddle_idx AS VARCHAR), ' [', lang, '].') AS prompt FROM picks""",
)
def x2_plan_generation(fx: Fixtures):
    plan = generation.plan_generation(
        _source(fx), _sanity_scores(fx), fx.pool, 2500, "Vary {riddle} [{answer}]."
    )
    return plan.select("call_idx", "riddle_idx", "prompt")


def _generated(fx: Fixtures) -> DataFrame:
    """Replies with lists of items: bare lists, objects that hold a list, broken ones."""
    n = F.col("doc_id").cast("string")

    def item(answer: Column) -> Column:
        return F.struct(
            F.concat(F.lit("o"), n).alias("original_riddle"),
            F.lit("a").alias("original_answer"),
            F.lit("because").alias("original_reasoning"),
            F.col("text").alias("altered_riddle"),
            answer.alias("altered_answer"),
            F.lit("since").alias("altered_reasoning"),
            F.lit("bias_probe").alias("type"),
        )

    both = F.array(item(F.col("lang")), item(F.when(F.col("doc_id") % 2 == 0, "").otherwise("x")))
    listed = F.to_json(both)
    kind = F.col("doc_id") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit('{"z": 1, "m": '), listed, F.lit(', "a": [1]}')))
        .when(kind == 2, F.lit("no list"))
        .when(kind == 3, F.lit('{"n": 5}'))
        .otherwise(listed)
    )
    failed = F.when(F.col("doc_id") % 17 == 0, F.lit("timeout"))
    return fx.table("documents").select(
        F.col("doc_id").alias("call_idx"), reply.alias("text"), failed.alias("error")
    )


GENERATED = """
calls AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 5 IN (0, 1, 4) AND doc_id % 17 <> 0),
items AS (SELECT doc_id, 0 AS pos, lang AS altered_answer, text FROM calls
          UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END, text FROM calls)"""


@check(
    "h10_generated_lists",
    "WITH " + GENERATED + " SELECT doc_id * 2147483648 + pos AS ord, CAST(altered_answer <> '' AS VARCHAR) AS valid FROM items",
)
def h10_generated_lists(fx: Fixtures):
    return generation.generated_items(_generated(fx)).select("ord", text("valid"))


@check(
    "b6_required_fields",
    "WITH " + GENERATED + " SELECT doc_id * 2147483648 + pos AS ord FROM items WHERE altered_answer <> ''",
)
def b6_required_fields(fx: Fixtures):
    return generation.generated_items(_generated(fx)).where("valid").select("ord")


@check(
    "x2b_ingest_generated",
    "WITH " + GENERATED + """
SELECT printf('raw_%04d', (SELECT count(*) FROM labels) + row_number() OVER (ORDER BY doc_id, pos)) AS id,
       concat('o', CAST(doc_id AS VARCHAR)) AS original_riddle, md5(text) AS digest, altered_answer, 'acme-1' AS source
FROM items WHERE altered_answer <> ''""",
)
def x2b_ingest_generated(fx: Fixtures):
    base = validation.row_count(fx.table("labels"))
    rows = generation.ingest_generated(_generated(fx), base, "acme-1")
    return rows.select(
        "id", "original_riddle", F.md5("altered_riddle").alias("digest"), "altered_answer", "source"
    )


# ── validation and review ─────────────────────────────────────────────


def _raw_items(fx: Fixtures) -> DataFrame:
    n = F.col("doc_id").cast("string")
    return fx.table("documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("raw_"), n).alias("id"),
        F.when(F.col("doc_id") % 29 == 4, "").otherwise(F.concat(F.lit("O "), n)).alias("original_riddle"),
        F.concat(F.lit("Answer "), (F.col("doc_id") % 3).cast("string")).alias("original_answer"),
        F.lit("why").alias("original_reasoning"),
        F.concat(F.lit("A "), F.md5("text")).alias("altered_riddle"),
        F.concat(F.lit("New "), F.col("lang")).alias("altered_answer"),
        F.lit("how").alias("altered_reasoning"),
        F.when(F.col("doc_id") % 4 != 0, "context_swap").alias("type"),
        F.col("source"),
    )


def _known(items: DataFrame, kind: int) -> DataFrame:
    """Items decided before, spelled differently."""
    return items.where(F.col("ord") % 6 == kind).select(
        F.concat(F.lit("  "), F.upper("original_riddle")).alias("original_riddle"),
        F.concat(F.lower("altered_riddle"), F.lit("\n")).alias("altered_riddle"),
    )


PENDING = "(doc_id % 29 = 4 OR doc_id % 6 NOT IN (0, 1))"


@check(
    "c4_pending_validation",
    f"SELECT doc_id AS ord FROM documents WHERE {PENDING}",
)
def c4_pending_validation(fx: Fixtures):
    raw = _raw_items(fx)
    return validation.pending_validation(raw, _known(raw, 0), _known(raw, 1)).select("ord")


@check(
    "g2_processed_keys",
    "SELECT DISTINCT concat('o ', CAST(doc_id AS VARCHAR)) AS a, concat('a ', md5(text)) AS b FROM documents "
    "WHERE doc_id % 6 IN (0, 1) AND doc_id % 29 <> 4",
)
def g2_processed_keys(fx: Fixtures):
    raw = _raw_items(fx)
    return resume.content_keys(_known(raw, 0), _known(raw, 1)).select("_key.*")


def _validator_replies(fx: Fixtures) -> DataFrame:
    """Verdicts as JSON; some unreadable, some failed."""
    d = F.col("doc_id")
    reply = F.to_json(
        F.struct(
            (d % 3 != 0).alias("overall_valid"),
            (d % 2).alias("answer_valid"),
            F.when(d % 7 == 0, "").otherwise("false").alias("is_distinct"),
            (d % 5 == 0).alias("is_logical"),
            (d % 8 == 0).alias("needs_review"),
            F.array(
                F.concat(F.lit("new "), F.upper("lang")), F.lit(" Other"), F.lit(" "), F.lit("other "),
                F.col("source"),
            ).alias("altered_accepted_answers"),
            F.array(F.lit("ANSWER 1 "), F.lit("Answer 2"), F.lit("tide")).alias("competing_answers"),
            F.col("lang").alias("reasoning"),
        )
    )
    body = F.when(d % 10 == 7, F.lit("[1]")).when(d % 10 == 8, F.lit("oops")).otherwise(reply)
    return fx.table("documents").select(
        d.alias("ord"), body.alias("text"), F.when(d % 19 == 0, "timeout").alias("error")
    )


ROUTED = f"""
routed AS (SELECT * FROM documents WHERE {PENDING} AND doc_id % 10 NOT IN (7, 8) AND doc_id % 19 <> 0)"""

COMPETING = """array_to_string(list_filter(['ANSWER 1 ', 'Answer 2', 'tide'],
  lambda a: lower(trim(a)) <> concat('answer ', CAST(doc_id % 3 AS VARCHAR))), '|')"""


def _routed(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    raw = _raw_items(fx)
    return validation.route_validated(
        raw, _validator_replies(fx), _known(raw, 0), _known(raw, 1)
    )


@check(
    "x3_validated_items",
    "WITH " + ROUTED + f"""
SELECT printf('val_%04d', (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) + row_number() OVER (ORDER BY doc_id)) AS id,
       doc_id AS ord, concat('New ', lang, '| Other|', source) AS altered_accepted_answers,
       {COMPETING} AS altered_competing_answers,
       CASE WHEN doc_id % 4 <> 0 THEN 'context_swap' ELSE 'constraint_addition' END AS type,
       CAST(doc_id % 2 = 1 AS VARCHAR) AS answer_valid, CAST(doc_id % 7 <> 0 AS VARCHAR) AS is_distinct,
       CAST(doc_id % 8 = 0 AS VARCHAR) AS needs_review, lang AS validation_reasoning
FROM routed WHERE doc_id % 3 <> 0""",
)
def x3_validated_items(fx: Fixtures):
    passed, _ = _routed(fx)
    return passed.select(
        "id", "ord", joined("altered_accepted_answers", "altered_accepted_answers"),
        joined("altered_competing_answers", "altered_competing_answers"), "type",
        text("answer_valid"), text("is_distinct"), text("needs_review"), "validation_reasoning",
    )


@check(
    "x3_rejected_items",
    "WITH " + ROUTED + f"""
SELECT doc_id AS ord, {COMPETING} AS altered_competing_answers, CAST(doc_id % 5 = 0 AS VARCHAR) AS is_logical,
       'false' AS is_clear
FROM routed WHERE doc_id % 3 = 0""",
)
def x3_rejected_items(fx: Fixtures):
    _, failed = _routed(fx)
    return failed.select(
        "ord", joined("altered_competing_answers", "altered_competing_answers"),
        text("is_logical"), text("is_clear"),
    )


@check(
    "b8_pass_fail_routing",
    "WITH " + ROUTED + " SELECT doc_id AS ord, CASE WHEN doc_id % 3 <> 0 THEN 'pass' ELSE 'fail' END AS route FROM routed",
)
def b8_pass_fail_routing(fx: Fixtures):
    passed, failed = _routed(fx)
    return passed.select("ord", F.lit("pass").alias("route")).union(
        failed.select("ord", F.lit("fail").alias("route"))
    )


@check(
    "b12_validated_projection",
    "WITH " + ROUTED + """
SELECT doc_id AS ord, concat('Answer ', CAST(doc_id % 3 AS VARCHAR)) AS original_accepted_answers, '' AS review_reason,
       source, md5(concat('A ', md5(text))) AS digest
FROM routed WHERE doc_id % 3 <> 0""",
)
def b12_validated_projection(fx: Fixtures):
    passed, _ = _routed(fx)
    return passed.select(
        "ord", joined("original_accepted_answers", "original_accepted_answers"), "review_reason",
        "source", F.md5("altered_riddle").alias("digest"),
    )


@check(
    "b13_rejected_projection",
    "WITH " + ROUTED + """
SELECT doc_id AS ord, concat('New ', lang) AS altered_answer, lang AS validation_reasoning
FROM routed WHERE doc_id % 3 = 0""",
)
def b13_rejected_projection(fx: Fixtures):
    _, failed = _routed(fx)
    return failed.select("ord", "altered_answer", "validation_reasoning")


@check(
    "b9_validity_agreement",
    "SELECT doc_id AS ord, CAST((doc_id % 3 <> 0) = (doc_id % 2 = 1 AND doc_id % 7 <> 0 AND doc_id % 5 = 0) AS VARCHAR) AS agrees "
    "FROM documents WHERE doc_id % 10 NOT IN (7, 8)",
)
def b9_validity_agreement(fx: Fixtures):
    checked = quality.with_validation(_validator_replies(fx))
    return checked.select("ord", text(quality.validity_agrees(), "agrees"))


@check(
    "h11_validation_objects",
    "SELECT doc_id AS ord FROM documents WHERE doc_id % 10 NOT IN (7, 8)",
)
def h11_validation_objects(fx: Fixtures):
    return quality.with_validation(_validator_replies(fx)).select("ord")


@check(
    "b3_retained_filter",
    with_views("validated") + "\nSELECT ord FROM fx_validated WHERE dedup_retained IS NULL OR dedup_retained",
)
def b3_retained_filter(fx: Fixtures):
    return fx.validated.where(quality.is_retained()).select("ord")


@check(
    "b4_review_routing",
    with_views("validated") + """
SELECT ord, CASE WHEN needs_review THEN 'review' ELSE 'pool' END AS route FROM fx_validated""",
)
def b4_review_routing(fx: Fixtures):
    return fx.validated.select(
        "ord", F.when(quality.is_flagged(), "review").otherwise("pool").alias("route")
    )


def _review_inputs(fx: Fixtures) -> dict[str, DataFrame]:
    items = fx.validated.select(
        "ord", "id",
        "original_riddle", F.md5("altered_riddle").alias("_m"), "altered_riddle",
        "altered_answer",
        F.array("altered_answer").alias("altered_accepted_answers"),
        F.array(F.lit("tide")).alias("altered_competing_answers"),
        "needs_review", "dedup_retained", F.col("ord").alias("place"),
    ).drop("_m")
    sides = ("original_riddle", "altered_riddle")
    action = F.element_at(
        F.array(*[F.lit(a) for a in "arese"]), (F.col("ord") % 5 + 1).cast("int")
    )
    first = items.where("ord % 3 <> 1").select(
        *sides, "ord", action.alias("action"),
        F.when(F.col("ord") % 2 == 0, " edited ").otherwise("").alias("edited_answer"),
        F.lit("x, ,y ").alias("edited_accepted"), F.lit("").alias("edited_competing"),
        (F.col("ord") % 4 != 0).alias("confirmed"),
    )
    return {
        "validated": items,
        "pool": items.where("ord % 13 = 2").select(*sides),
        "human_rejected": items.where("ord % 13 = 3").select(*sides),
        "decisions": first,
    }


# Items of equal content share one decision, the last one.
REVIEW = """
keyed AS (SELECT *, CASE WHEN altered_riddle <> '' THEN concat(original_riddle, chr(1), lower(regexp_replace(altered_riddle, '^\\s+|\\s+$', '', 'g'))) END AS k
          FROM fx_validated),
done AS (SELECT k FROM keyed WHERE ord % 13 IN (2, 3) AND k IS NOT NULL),
open_items AS (SELECT * FROM keyed WHERE (dedup_retained IS NULL OR dedup_retained) AND (k IS NULL OR k NOT IN (SELECT k FROM done))),
decided AS (SELECT k, max(ord) AS d FROM keyed WHERE ord % 3 <> 1 AND k IS NOT NULL GROUP BY k),
acted AS (
  SELECT o.*, d, CASE WHEN NOT coalesce(needs_review, FALSE) THEN 'auto'
              WHEN d IS NULL OR d % 5 = 3 THEN 'pending'
              WHEN d % 5 = 1 OR (d % 5 IN (2, 4) AND d % 4 = 0) THEN 'rejected' ELSE 'approved' END AS route
  FROM open_items o LEFT JOIN decided USING (k))"""


def _reviewed(fx: Fixtures) -> dict[str, DataFrame]:
    return validation.review_route(**_review_inputs(fx))


@check(
    "c5_review_anti_join",
    with_views("validated") + f""",{REVIEW} SELECT ord FROM open_items""",
)
def c5_review_anti_join(fx: Fixtures):
    tables = _review_inputs(fx)
    return validation.review_candidates(
        tables["validated"], tables["pool"], tables["human_rejected"]
    ).select("ord")


@check(
    "c19_review_decisions",
    with_views("validated") + f""",{REVIEW}
SELECT id, CASE route WHEN 'auto' THEN 'pool' WHEN 'approved' THEN 'pool' ELSE route END AS route,
       CASE WHEN route IN ('auto', 'pending') OR d % 5 NOT IN (2, 4) OR d % 2 = 1 THEN altered_answer ELSE 'edited' END AS altered_answer,
       CASE WHEN route IN ('auto', 'pending') OR d % 5 NOT IN (2, 4) THEN altered_answer ELSE 'x|y' END AS accepted
FROM acted""",
)
def c19_review_decisions(fx: Fixtures):
    tables = _review_inputs(fx)
    routed = validation.review_route(**tables)
    parts = None
    for name in ("pool", "rejected", "pending"):
        rows = routed[name].withColumn("ord", F.col("place"))
        part = rows.drop("id").join(tables["validated"].select("ord", "id"), "ord").select(
            "id", F.lit(name).alias("route"), "altered_answer",
            joined("altered_accepted_answers", "accepted"),
        )
        parts = part if parts is None else parts.union(part)
    return parts


@check(
    "x6_review_pool_ids",
    with_views("validated") + f""",{REVIEW}
SELECT printf('pool_%04d', (SELECT count(*) FROM fx_validated WHERE ord % 13 = 2)
              + row_number() OVER (ORDER BY CASE route WHEN 'auto' THEN 0 ELSE 1 END, ord)) AS id, ord
FROM acted WHERE route IN ('auto', 'approved')""",
)
def x6_review_pool_ids(fx: Fixtures):
    routed = validation.review_route(**_review_inputs(fx))
    return routed["pool"].select("id", F.col("place").alias("ord"))


# ── duplicates ────────────────────────────────────────────────────────


def _dedup_rows(fx: Fixtures) -> DataFrame:
    accepted = F.transform(F.sequence(F.lit(0), F.col("n_accepted")), lambda i: i.cast("string"))
    return fx.validated.select("ord", "id", "altered_riddle", accepted.alias("altered_accepted_answers"))


NORM = r"""trim(regexp_replace(regexp_replace(lower(altered_riddle), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))"""
EQUAL = f"""
norm AS (SELECT ord, id, n_accepted, {NORM} AS t FROM fx_validated),
grp AS (SELECT *, CASE WHEN t = '' THEN ord ELSE min(ord) OVER (PARTITION BY t) END AS component FROM norm)"""


@check(
    "h2_comparison_text",
    f"SELECT doc_id, md5({NORM.replace('altered_riddle', 'text')}) AS digest FROM documents",
)
def h2_comparison_text(fx: Fixtures):
    return fx.table("documents").select(
        "doc_id", F.md5(txt.comparison_text("text")).alias("digest")
    )


@check(
    "c16_equal_text_groups",
    with_views("validated") + f""",{EQUAL} SELECT ord, component FROM grp""",
)
def c16_equal_text_groups(fx: Fixtures):
    return duplicates.duplicate_groups(_dedup_rows(fx), threshold=2.0)


@check(
    "e4_group_representatives",
    with_views("validated") + f""",{EQUAL}
SELECT component, id AS best_id FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY n_accepted DESC, ord) AS rn FROM grp) g WHERE rn = 1""",
)
def e4_group_representatives(fx: Fixtures):
    rows = _dedup_rows(fx)
    groups = duplicates.duplicate_groups(rows, threshold=2.0)
    return duplicates.representatives(rows, groups).select("component", "best_id")


@check(
    "x5_mark_equal_texts",
    with_views("validated") + f""",{EQUAL}
SELECT ord, CAST(rn = 1 AS VARCHAR) AS dedup_retained, CASE WHEN rn > 1 THEN best ELSE '-' END AS dedup_duplicate_of FROM (
  SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS best FROM grp
  WINDOW w AS (PARTITION BY CASE WHEN t = '' THEN CAST(ord AS VARCHAR) ELSE t END ORDER BY n_accepted DESC, ord)) g""",
)
def x5_mark_equal_texts(fx: Fixtures):
    return duplicates.mark_duplicates(_dedup_rows(fx), threshold=2.0).select(
        "ord", text("dedup_retained"), F.coalesce("dedup_duplicate_of", F.lit("-")).alias("dedup_duplicate_of")
    )


@check("x5_mark_duplicates")
def x5_mark_duplicates(fx: Fixtures):
    """Near-duplicates at the default threshold; tested against all pairs on small texts."""
    return duplicates.mark_duplicates(_dedup_rows(fx)).select(
        "ord", "id", "dedup_retained", "dedup_duplicate_of"
    )


@check("c16_similar_pairs")
def c16_similar_pairs(fx: Fixtures):
    return duplicates.similar_pairs(duplicates.distinct_texts(_dedup_rows(fx)))


@check("h3_similarity_ratio")
def h3_similarity_ratio(fx: Fixtures):
    """Ratio of every first turn and its reply."""
    from evalweave.functions.similarity import similarity_ratio

    turns = fx.table("conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")
    )
    pairs = a.join(b, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(similarity_ratio("a", "b"), 6).alias("ratio"))


@check(
    "d24_connected_components",
    """SELECT node, component FROM (
         SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component,
                count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) q WHERE n > 1""",
)
def d24_connected_components(fx: Fixtures):
    """Orders chained to the customer's next order by total price: one component per customer."""
    following = F.lead("o_orderkey").over(
        Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    )
    edges = fx.table("orders").select(F.col("o_orderkey").alias("u"), following.alias("v"))
    return connected_components(edges.where("v IS NOT NULL"))


# ── selection ─────────────────────────────────────────────────────────

FAMILY = """CASE WHEN trim(source) = '' THEN '__unknown__' WHEN source LIKE 'openai/gpt%' THEN 'gpt'
  WHEN source = 'Gemini-b' THEN 'gemini' WHEN source LIKE 'qwen%' THEN 'q-c' WHEN source LIKE 'glm%' THEN 'glm' ELSE 'x' END"""


@check(
    "c17_model_families",
    with_views("pool") + f"\nSELECT ord, {FAMILY} AS family FROM fx_pool",
)
def c17_model_families(fx: Fixtures):
    return selection.with_family(fx.pool).select("ord", "family")


@check(
    "c17_family_table",
    """
WITH t AS (SELECT substr(p_name, 1, 2 + p_size % 5) AS prefix, min(p_partkey) AS o FROM part WHERE p_size % 3 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(arg_min(prefix, o), p_name) AS family
FROM part LEFT JOIN t ON starts_with(p_name, prefix) GROUP BY p_partkey, p_name""",
)
def c17_family_table(fx: Fixtures):
    """Families given as a table; here the first letters of parts whose size is a multiple of three."""
    part = fx.table("part")
    cut = F.expr("substring(p_name, 1, 2 + p_size % 5)")
    families = part.where("p_size % 3 = 0").groupBy(cut.alias("prefix")).agg(F.min("p_partkey").alias("ord"))
    families = families.withColumn("value", F.col("prefix"))
    return selection.with_family(part.withColumnRenamed("p_name", "source"), families).select(
        "p_partkey", "family"
    )


@check(
    "d9_family_breakdown",
    with_views("pool") + f"\nSELECT {FAMILY} AS family, count(*) AS n FROM fx_pool GROUP BY 1",
)
def d9_family_breakdown(fx: Fixtures):
    return selection.family_breakdown(fx.pool)


@check(
    "b2_pending_pool",
    with_views("pool") + """
SELECT ord, CASE WHEN coalesce(used_in_set, FALSE) THEN 'used' ELSE 'pending' END AS state FROM fx_pool""",
)
def b2_pending_pool(fx: Fixtures):
    pool = fx.pool
    return quality.pending_pool(pool).select("ord", F.lit("pending").alias("state")).union(
        quality.used_pool(pool).select("ord", F.lit("used").alias("state"))
    )


STATUS = f"""
state AS (SELECT {FAMILY} AS family, CASE WHEN coalesce(used_in_set, FALSE) THEN 'used' ELSE 'pending' END AS part FROM fx_pool)
SELECT 'auxiliary' AS part, '-' AS family, count(*) AS n FROM fx_entries WHERE set_name = 'auxiliary'
UNION ALL SELECT 'fixed', '-', count(*) FROM fx_entries WHERE set_name = 'fixed'
UNION ALL SELECT 'total', '-', count(*) FROM fx_entries
UNION ALL SELECT coalesce(part, 'pool'), coalesce(family, '-'), count(*) FROM state GROUP BY GROUPING SETS ((), (part), (part, family))"""


def _status(fx: Fixtures) -> DataFrame:
    entries = fx.entries
    return promotion.pool_status(
        entries.where("set_name = 'auxiliary'"), entries.where("set_name = 'fixed'"), fx.pool
    ).withColumn("family", F.coalesce("family", F.lit("-")))


@check("d10_pool_report", with_views("pool", "entries") + "," + STATUS)
def d10_pool_report(fx: Fixtures):
    return _status(fx)


@check("x10_pool_status", with_views("pool", "entries") + "," + STATUS)
def x10_pool_status(fx: Fixtures):
    return _status(fx)


@check(
    "d15_max_id",
    with_views("entries") + "\nSELECT CAST(max(CAST(substr(id, 5) AS BIGINT)) AS BIGINT) AS base FROM fx_entries",
)
def d15_max_id(fx: Fixtures):
    odd = fx.outputs.select(F.concat(F.lit("x"), "riddle_id").alias("id"))
    return selection.max_id_number(fx.entries.select("id").union(odd))


# Existing entries for quotas: the used pool items.
QUOTA = """
uses AS (SELECT lower(trim(original_riddle)) AS k, count(*) AS n FROM fx_pool
         WHERE coalesce(used_in_set, FALSE) AND trim(original_riddle) <> '' GROUP BY 1),
quota AS (SELECT p.ord, lower(trim(original_riddle)) AS k,
                 trim(original_riddle) <> '' AND coalesce(n, 0) >= 2 AS blocked
          FROM fx_pool p LEFT JOIN uses ON k = lower(trim(original_riddle)) WHERE NOT coalesce(used_in_set, FALSE))"""


def _existing(fx: Fixtures) -> DataFrame:
    return quality.used_pool(fx.pool)


@check(
    "c18_quota_join",
    with_views("pool") + f""",{QUOTA} SELECT ord, CAST(blocked AS VARCHAR) AS blocked FROM quota""",
)
def c18_quota_join(fx: Fixtures):
    return selection.with_quota(fx.pool, _existing(fx), 2).select("ord", text("blocked"))


@check(
    "d17_eligibility",
    with_views("pool") + f""",{QUOTA}
SELECT count(*) AS pending, count(*) FILTER (NOT blocked) AS eligible, count(*) FILTER (blocked) AS blocked FROM quota""",
)
def d17_eligibility(fx: Fixtures):
    return selection.eligibility(fx.pool, _existing(fx), 2)


@check(
    "f3_top_blocked",
    with_views("pool") + f""",{QUOTA}
SELECT k AS original_key, count(*) AS n FROM quota WHERE blocked GROUP BY k ORDER BY n DESC, k LIMIT 5""",
)
def f3_top_blocked(fx: Fixtures):
    return selection.top_blocked(fx.pool, _existing(fx), 2)


@check(
    "f8_split_sizes",
    "SELECT CAST(floor(count(*) * (30.0 / 100030)) AS BIGINT) AS n_fixed, "
    "CAST(count(*) - floor(count(*) * (30.0 / 100030)) AS BIGINT) AS n_auxiliary FROM documents",
)
def f8_split_sizes(fx: Fixtures):
    return promotion.split_sizes(fx.pool, 30, 100_000)


ROUNDS = f"""
fam AS (SELECT ord, {FAMILY} AS family FROM fx_pool WHERE NOT coalesce(used_in_set, FALSE)),
firsts AS (SELECT family, row_number() OVER (ORDER BY min(ord)) AS family_ord FROM fam GROUP BY family),
placed AS (SELECT ord, family_ord, row_number() OVER (PARTITION BY family ORDER BY ord) AS rnd FROM fam JOIN firsts USING (family)),
picked AS (SELECT ord, row_number() OVER (ORDER BY rnd, family_ord) AS pick FROM placed)"""


@check(
    "e6_round_robin",
    with_views("pool") + f""",{ROUNDS} SELECT ord, pick FROM picked""",
)
def e6_round_robin(fx: Fixtures):
    """The rounds without a cap."""
    return selection.balanced_order(fx.pool)


def capped_rounds(name: str, pool: str, uses: str, cap: int) -> str:
    """The capped rounds, one turn per step: ``pool`` is played, ``uses`` (k, n) counts what is taken.

    The state is the next place in every family's queue and the room left per original.
    """
    return f"""
fam_{name} AS (SELECT ord, {FAMILY} AS family, lower(trim(coalesce(original_riddle, ''))) AS k FROM {pool}),
first_{name} AS (SELECT family, row_number() OVER (ORDER BY min(ord)) AS f FROM fam_{name} GROUP BY family),
cand_{name} AS (
  SELECT ord, f, dense_rank() OVER (ORDER BY k) AS kid, CASE WHEN k = '' THEN 1000000000 ELSE {cap} - coalesce(n, 0) END AS room
  FROM fam_{name} JOIN first_{name} USING (family) LEFT JOIN {uses} USING (k)),
queue_{name} AS (
  SELECT list(o ORDER BY f) AS os, list(q ORDER BY f) AS ks FROM
  (SELECT f, list(ord ORDER BY ord) AS o, list(kid ORDER BY ord) AS q FROM cand_{name} GROUP BY f)),
room_{name} AS (SELECT list(room ORDER BY kid) AS room FROM (SELECT DISTINCT kid, room FROM cand_{name})),
play_{name}(step, f, idle, ptr, room, got) AS (
  SELECT 0, 1, 0, list_transform(os, lambda x: 1), room, CAST(NULL AS BIGINT) FROM queue_{name}, room_{name}
  UNION ALL
  SELECT step + 1, CASE WHEN held AND NOT take THEN f ELSE f % len(os) + 1 END,
         CASE WHEN take THEN 0 WHEN held THEN idle ELSE idle + 1 END,
         CASE WHEN held THEN list_transform(ptr, lambda x, j: CASE WHEN j = f THEN x + 1 ELSE x END) ELSE ptr END,
         CASE WHEN take THEN list_transform(room, lambda x, j: CASE WHEN j = kid THEN x - 1 ELSE x END) ELSE room END,
         CASE WHEN take THEN os[f][ptr[f]] END
  FROM (SELECT *, held AND coalesce(room[kid] > 0, FALSE) AS take FROM
    (SELECT *, ptr[f] <= len(os[f]) AS held, ks[f][ptr[f]] AS kid FROM play_{name}, queue_{name} WHERE idle < len(os)) q) r),
picked_{name} AS (SELECT got AS ord, row_number() OVER (ORDER BY step) AS pick FROM play_{name} WHERE got IS NOT NULL)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


PENDING = "pend AS (SELECT * FROM fx_pool WHERE NOT coalesce(used_in_set, FALSE))"


@check(
    "e6_round_robin_capped",
    _recursive(with_views("pool")) + f""",{QUOTA}, {PENDING},{capped_rounds("a", "pend", "uses", 2)}
SELECT ord, pick FROM picked_a""",
)
def e6_round_robin_capped(fx: Fixtures):
    return selection.balanced_order(fx.pool, cap=2, existing=_existing(fx))


@check(
    "x4_balanced_pick",
    with_views("pool") + f""",{ROUNDS}
SELECT p.ord, CASE WHEN pick <= 150 THEN 'true' ELSE coalesce(CAST(used_in_set AS VARCHAR), '-') END AS used_in_set,
       CASE WHEN pick <= 150 THEN 'benchmark' ELSE coalesce(used_set, '-') END AS used_set
FROM fx_pool p LEFT JOIN picked USING (ord)""",
)
def x4_balanced_pick(fx: Fixtures):
    _, marked = selection.balanced_pick(fx.pool, 150)
    return marked.select(
        "ord",
        F.coalesce(text("used_in_set"), F.lit("-")).alias("used_in_set"),
        F.coalesce("used_set", F.lit("-")).alias("used_set"),
    )


@check(
    "x7_promote_add",
    with_views("pool", "entries") + f""",{ROUNDS}
SELECT printf('alt_%04d', (SELECT count(*) FROM fx_entries) + pick) AS id, ord % 1000003 AS item FROM picked WHERE pick <= 200""",
)
def x7_promote_add(fx: Fixtures):
    entries = fx.entries
    added, _ = promotion.promote_add(
        fx.pool.withColumn("item", F.col("ord") % 1000003),
        entries.where("set_name = 'auxiliary'"), entries.where("set_name = 'fixed'"), 200, cap=None,
    )
    return added.select("id", "item")


@check(
    "x7_promote_add_capped",
    _recursive(with_views("pool", "entries")) + f""", {PENDING},
sets AS (SELECT lower(trim(original_riddle)) AS k, count(*) AS n FROM fx_entries
         WHERE trim(original_riddle) <> '' GROUP BY 1),{capped_rounds("a", "pend", "sets", 2)}
SELECT printf('alt_%04d', (SELECT max(CAST(substr(id, 5) AS BIGINT)) FROM fx_entries) + pick) AS id, 'fixed' AS "set", original_riddle
FROM picked_a JOIN fx_pool USING (ord) WHERE pick <= 200""",
)
def x7_promote_add_capped(fx: Fixtures):
    entries = fx.entries
    added, _ = promotion.promote_add(
        fx.pool, entries.where("set_name = 'auxiliary'"), entries.where("set_name = 'fixed'"),
        200, "fixed", cap=2,
    )
    return added.select("id", "set", "original_riddle")


@check(
    "x8_promote_split",
    with_views("pool") + f""",{ROUNDS},
rest AS (SELECT ord, family FROM fam WHERE ord NOT IN (SELECT ord FROM picked WHERE pick <= 60)),
again AS (SELECT family, row_number() OVER (ORDER BY min(ord)) AS family_ord FROM rest GROUP BY family),
turns AS (SELECT ord, family_ord, row_number() OVER (PARTITION BY family ORDER BY ord) AS rnd FROM rest JOIN again USING (family)),
second AS (SELECT ord, row_number() OVER (ORDER BY rnd, family_ord) AS pick FROM turns)
SELECT printf('alt_%04d', pick) AS id, 'fixed' AS set_name, ord % 1000003 AS item FROM picked WHERE pick <= 60
UNION ALL SELECT printf('alt_%04d', 60 + pick), 'auxiliary', ord % 1000003 FROM second WHERE pick <= 90""",
)
def x8_promote_split(fx: Fixtures):
    pool = fx.pool.withColumn("item", F.col("ord") % 1000003)
    fixed, auxiliary, _ = promotion.promote_split(pool, 60, 90, cap=None)
    return fixed.unionByName(auxiliary).select("id", F.col("set").alias("set_name"), "item")


@check(
    "x8_promote_split_capped",
    _recursive(with_views("pool")) + f""", {PENDING},
none AS (SELECT 'x' AS k, 0 AS n WHERE FALSE),{capped_rounds("a", "pend", "none", promotion.CAP)},
chosen AS (SELECT ord, pick, original_riddle FROM picked_a JOIN fx_pool USING (ord) WHERE pick <= 60),
sets AS (SELECT lower(trim(original_riddle)) AS k, count(*) AS n FROM chosen WHERE trim(original_riddle) <> '' GROUP BY 1),
rest AS (SELECT * FROM pend WHERE ord NOT IN (SELECT ord FROM chosen)),{capped_rounds("b", "rest", "sets", promotion.CAP)}
SELECT printf('alt_%04d', pick) AS id, 'fixed' AS "set", original_riddle FROM chosen
UNION ALL SELECT printf('alt_%04d', 60 + pick), 'auxiliary', original_riddle
FROM picked_b JOIN fx_pool USING (ord) WHERE pick <= 90""",
)
def x8_promote_split_capped(fx: Fixtures):
    fixed, auxiliary, _ = promotion.promote_split(fx.pool, 60, 90)
    return fixed.unionByName(auxiliary).select("id", "set", "original_riddle")


@check(
    "x9_refresh_auxiliary",
    with_views("pool", "entries") + f""",{ROUNDS},
base AS (SELECT max(CAST(substr(id, 5) AS BIGINT)) AS b FROM fx_entries WHERE set_name = 'fixed')
SELECT printf('alt_%04d', b + pick) AS id, ord % 1000003 AS item FROM picked, base WHERE pick <= 120""",
)
def x9_refresh_auxiliary(fx: Fixtures):
    fixed = fx.entries.where("set_name = 'fixed'")
    pool = fx.pool.withColumn("item", F.col("ord") % 1000003)
    fresh, _ = promotion.refresh_auxiliary(pool, fixed, 120, cap=None)
    return fresh.select("id", "item")


@check(
    "d18_stage_counters",
    "WITH " + GENERATED + """
SELECT 'generated' AS stage, count(*) FILTER (altered_answer <> '') AS n FROM items
UNION ALL SELECT 'skipped', count(*) FILTER (altered_answer = '') FROM items""",
)
def d18_stage_counters(fx: Fixtures):
    """Counters observed while the rows are used; the two numbers come back as rows."""
    seen = Observation("generation")
    rows = generation.ingest_generated(_generated(fx), 0, "acme-1", seen)
    rows.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return fx.spark.createDataFrame(sorted(counts.items()), "stage STRING, n BIGINT")


def _stored(fx: Fixtures, tables: list[DataFrame], seen: list[Observation]) -> DataFrame:
    """Use every table once, then give the observed counters as rows."""
    for table in tables:
        table.write.format("noop").mode("overwrite").save()
    counts = [pair for o in seen for pair in o.get.items()]
    return fx.spark.createDataFrame(sorted(counts), "stage STRING, n BIGINT")


@check(
    "d18_validation_counters",
    "WITH " + ROUTED + """
SELECT 'passed' AS stage, count(*) FILTER (doc_id % 3 <> 0) AS n FROM routed
UNION ALL SELECT 'failed', count(*) FILTER (doc_id % 3 = 0) FROM routed""",
)
def d18_validation_counters(fx: Fixtures):
    seen = Observation("passed"), Observation("failed")
    raw = _raw_items(fx)
    routed = validation.route_validated(
        raw, _validator_replies(fx), _known(raw, 0), _known(raw, 1), seen
    )
    return _stored(fx, list(routed), list(seen))


@check(
    "d18_duplicate_counters",
    with_views("validated") + f""",{EQUAL},
firsts AS (SELECT count(DISTINCT CASE WHEN t = '' THEN CAST(ord AS VARCHAR) ELSE concat('t', t) END) AS k, count(*) AS n FROM grp)
SELECT 'total' AS stage, n FROM firsts UNION ALL SELECT 'retained', k FROM firsts UNION ALL SELECT 'duplicates', n - k FROM firsts""",
)
def d18_duplicate_counters(fx: Fixtures):
    seen = Observation("duplicates")
    marked = duplicates.mark_duplicates(_dedup_rows(fx), threshold=2.0, observation=seen)
    return _stored(fx, [marked], [seen])


@check(
    "d18_promotion_counters",
    with_views("pool") + f""",{ROUNDS},
moved AS (SELECT count(*) AS n FROM picked WHERE pick <= 150),
before AS (SELECT count(*) FILTER (used_in_set) AS used, count(*) AS n FROM fx_pool)
SELECT 'promoted' AS stage, n FROM moved
UNION ALL SELECT 'used', used + moved.n FROM before, moved
UNION ALL SELECT 'pending', before.n - used - moved.n FROM before, moved""",
)
def d18_promotion_counters(fx: Fixtures):
    entries = fx.entries
    added, after = promotion.promote_add(
        fx.pool, entries.where("set_name = 'auxiliary'"), entries.where("set_name = 'fixed'"), 150, cap=None
    )
    seen = Observation("promoted"), Observation("pool")
    return _stored(fx, list(promotion.observed_promotion(added, after, seen)), list(seen))


# ── scoring ───────────────────────────────────────────────────────────


def _judge(prompt: str) -> tuple[str, int, int]:
    """Stands in for a model: fails on some prompts, else answers their length."""
    if len(prompt) % 7 == 0:
        raise ValueError("no answer")
    return f'{{"answer": {len(prompt)}}}', len(prompt), 1


@check(
    "j1_score_prompts",
    """SELECT doc_id, CASE WHEN length(p) % 7 = 0 THEN '-' ELSE concat('{"answer": ', CAST(length(p) AS VARCHAR), '}') END AS reply,
              CASE WHEN length(p) % 7 = 0 THEN 'no answer' ELSE '-' END AS error,
              CASE WHEN length(p) % 7 = 0 THEN -1 ELSE length(p) END AS input_tokens
       FROM (SELECT doc_id, concat('Solve: ', text) AS p FROM documents) q""",
)
def j1_score_prompts(fx: Fixtures):
    prompts = fx.table("documents").select("doc_id", render("Solve: {t}", t="text").alias("prompt"))
    scored = score_prompts(prompts, _judge, ["doc_id"], partitions=8)
    return scored.select(
        "doc_id",
        F.coalesce("text", F.lit("-")).alias("reply"),
        F.coalesce("error", F.lit("-")).alias("error"),
        F.coalesce("input_tokens", F.lit(-1)).alias("input_tokens"),
    )
