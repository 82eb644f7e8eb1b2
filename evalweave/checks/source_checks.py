"""Queries that write shapes of the given tables as files and scan them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave import schemas
from evalweave.checks.fixtures import Fixtures, with_views
from evalweave.checks.registry import check, text
from evalweave.functions.text import run_name
from evalweave.plans import evaluation
from evalweave.session import scratch_path
from evalweave.sources import documents, jsonl


def ordered_parts(df: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """Part files that follow one another in ``order``."""
    return df.repartitionByRange(parts, order).sortWithinPartitions(order)


def _lines(fx: Fixtures) -> str:
    """JSONL lines of the documents; some blank, some malformed, some with an odd type."""
    body = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    odd = F.to_json(F.struct("doc_id", "lang", "source", F.lit("many").alias("n_chars")))
    kind = F.col("doc_id") % 7
    value = (
        F.when(kind == 1, "  ")
        .when(kind == 2, F.concat(F.lit("not json {"), F.col("lang")))
        .when(kind == 3, odd)
        .when(kind == 4, F.concat(body, F.lit(" trailing")))
        .otherwise(F.concat(F.lit("  "), body))
    )
    path = scratch_path(fx.spark, "lines")
    ordered_parts(fx.table("documents").select("doc_id", value.alias("value")), "doc_id").select(
        "value"
    ).write.text(path)
    return path


LINE_SCHEMA = "doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT"


@check(
    "a1_scan_jsonl",
    """SELECT doc_id AS ord, doc_id, lang, source,
              CASE WHEN doc_id % 7 = 3 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS n_chars
       FROM documents WHERE doc_id % 7 NOT IN (1, 2, 4)""",
)
def a1_scan_jsonl(fx: Fixtures):
    return jsonl.scan_jsonl(fx.spark, _lines(fx), LINE_SCHEMA).withColumn(
        "n_chars", F.coalesce(F.col("n_chars").cast("string"), F.lit(""))
    )


@check(
    "a1_malformed_lines",
    "SELECT doc_id AS ord FROM documents WHERE doc_id % 7 IN (2, 4)",
)
def a1_malformed_lines(fx: Fixtures):
    return jsonl.malformed_lines(fx.spark, _lines(fx)).select("ord")


@check(
    "a2_scan_if_exists",
    "SELECT doc_id FROM documents WHERE doc_id % 7 NOT IN (1, 2, 4)",
)
def a2_scan_if_exists(fx: Fixtures):
    missing = jsonl.scan_jsonl_if_exists(
        fx.spark, scratch_path(fx.spark, "missing"), LINE_SCHEMA
    )
    present = jsonl.scan_jsonl_if_exists(fx.spark, _lines(fx), LINE_SCHEMA)
    return present.unionByName(missing).select("doc_id")


@check(
    "a3_scan_source_list",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS riddle_idx,
              concat(source, ', who, ', CAST(n_chars AS VARCHAR), '?') AS riddle, lang AS answer
       FROM documents WHERE doc_id % 5 NOT IN (1, 2)""",
)
def a3_scan_source_list(fx: Fixtures):
    kind = F.col("doc_id") % 5
    line = (
        F.when(kind == 1, F.col("source"))
        .when(kind == 2, F.concat(F.lit(","), F.col("lang")))
        .otherwise(
            F.concat("source", F.lit(", who, "), F.col("n_chars").cast("string"), F.lit("? , "), "lang")
        )
    )
    path = scratch_path(fx.spark, "source")
    rows = ordered_parts(fx.table("documents").select("doc_id", line.alias("riddles,answers")), "doc_id")
    rows.drop("doc_id").write.option("header", True).option("sep", "\t").csv(path)
    return documents.scan_source_list(fx.spark, path).select("riddle_idx", "riddle", "answer")


OUTPUT_FIELDS = [f.strip().split(" ")[0] for f in schemas.MODEL_OUTPUTS.split(",")]


def _run_files(fx: Fixtures) -> str:
    folder = scratch_path(fx.spark, "runs")
    out = fx.outputs
    named = out.withColumn("file", F.concat("run_id", F.lit(".jsonl")))
    smoke = named.where("run_id = 'run_1'").withColumn(
        "file", F.concat("run_id", F.lit("_one_entry_test.jsonl"))
    )
    fields = [c for c in OUTPUT_FIELDS if c in out.columns]
    named.union(smoke).select("file", *fields).write.partitionBy("file").json(folder)
    return folder


@check(
    "a4_scan_runs",
    with_views("outputs") + """
SELECT run_id, riddle_id, riddle_type, sample_index, model_answer, model, provider,
       coalesce(quantization, '-') AS quantization, CAST(reasoning_enabled AS VARCHAR) AS reasoning_enabled,
       coalesce(output_tokens, -1) AS output_tokens
FROM fx_outputs""",
)
def a4_scan_runs(fx: Fixtures):
    return documents.scan_runs(fx.spark, _run_files(fx)).select(
        "run_id",
        "riddle_id",
        "riddle_type",
        "sample_index",
        "model_answer",
        "model",
        "provider",
        F.coalesce("quantization", F.lit("-")).alias("quantization"),
        text("reasoning_enabled"),
        F.coalesce("output_tokens", F.lit(-1)).alias("output_tokens"),
    )


@check(
    "a5_scan_solver_answers",
    with_views("sanity_answers") + """
SELECT CASE WHEN solver = 'solver_3' THEN 'stem_3' ELSE solver END AS solver, riddle_idx, riddle, model_answer
FROM fx_sanity_answers""",
)
def a5_scan_solver_answers(fx: Fixtures):
    folder = scratch_path(fx.spark, "answers")
    rows = fx.sanity_answers.select(
        F.concat(F.lit("stem_"), F.col("solver_ord").cast("string"), F.lit(".jsonl")).alias("file"),
        "riddle_idx",
        "riddle",
        "expected_answer",
        "model_answer",
        F.when(F.col("solver") != "solver_3", F.col("solver")).alias("solver"),
    )
    rows.write.partitionBy("file").json(folder)
    return documents.scan_solver_answers(fx.spark, folder).select(
        "solver", "riddle_idx", "riddle", "model_answer"
    )


def evaluation_of(fx: Fixtures) -> evaluation.Evaluation:
    verdict = F.struct("correct", "gave_original", "competing")
    judged = fx.judgments.withColumn("judgment", verdict).drop(
        "correct", "gave_original", "competing"
    )
    return evaluation.evaluate_runs(fx.outputs, judged, fx.entries)


#: Documents per file. A folder for each would make its listing and the commit the longest step.
DOCUMENTS = 32


def write_evaluations(docs: DataFrame, folder: str) -> None:
    """A JSON array of some documents per file, on one line, from a row for each document."""
    place = F.floor(F.col("part") / DOCUMENTS).cast("string")
    # Not null, or the write would sort by name alone and lose the order of the parts.
    name = F.coalesce(F.concat("run_id", F.lit("_"), place, F.lit("_eval.json")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    doc, first = F.to_json(F.struct("*")), F.col("part") % DOCUMENTS == 0
    line = F.struct("part", F.concat(F.when(first, F.lit("[")).otherwise(F.lit(",")), doc).alias("value"))
    end = F.struct(F.lit((1 << 63) - 1).alias("part"), F.lit("]").alias("value"))
    lines = docs.select(name.alias("name"), F.explode(F.when(first, F.array(line, end)).otherwise(F.array(line))).alias("_l"))
    lines = lines.select("name", "_l.*").repartition("name").sortWithinPartitions("name", "part")
    lines.select("name", "value").write.partitionBy("name").option("lineSep", " ").text(folder)


def stored_evaluations(fx: Fixtures) -> DataFrame:
    """The evaluated runs, written as documents of a thousand samples, some in a file, and read again."""
    folder = scratch_path(fx.spark, "evals")
    docs = evaluation_of(fx).documents(max_samples=1000)
    write_evaluations(docs, folder)
    return documents.scan_evaluations(fx.spark, folder)


@check(
    "a6_scan_evaluations",
    with_views("outputs") + """
SELECT run_id, riddle_id, riddle_type, sample_index, model_answer FROM fx_outputs WHERE riddle_id LIKE 'alt%'""",
)
def a6_scan_evaluations(fx: Fixtures):
    return documents.evaluation_details(stored_evaluations(fx)).select(
        "run_id", "riddle_id", "riddle_type", "sample_index", "model_answer"
    )


@check(
    "a7_scan_sanity_results",
    with_views("sanity_answers") + """
SELECT riddle_idx, count(DISTINCT solver) AS models_evaluated FROM fx_sanity_answers GROUP BY riddle_idx""",
)
def a7_scan_sanity_results(fx: Fixtures):
    """One report document, written and read again."""
    from evalweave.checks.curation_checks import sanity_inputs
    from evalweave.plans.sanity import sanity_documents, sanity_report

    path = scratch_path(fx.spark, "sanity")
    documents.write_document(sanity_documents(sanity_report(*sanity_inputs(fx))).drop("part"), path)
    return documents.scan_sanity_results(fx.spark, path).select("riddle_idx", "models_evaluated")


@check(
    "a8_append_jsonl",
    "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, source FROM documents",
)
def a8_append_jsonl(fx: Fixtures):
    path = scratch_path(fx.spark, "append")
    docs = fx.table("documents")
    jsonl.append_jsonl(docs.select("doc_id", "lang"), path)
    jsonl.append_jsonl(docs.select("doc_id", F.col("source").alias("lang")), path)
    return jsonl.scan_jsonl(fx.spark, path, "doc_id BIGINT, lang STRING").drop("ord")


@check(
    "a9_write_jsonl",
    "SELECT doc_id, upper(lang) AS lang, md5(text) AS digest FROM documents WHERE doc_id % 3 = 0",
)
def a9_write_jsonl(fx: Fixtures):
    """Overwrites a folder with rows read from that same folder."""
    path = scratch_path(fx.spark, "rewrite")
    schema = "doc_id BIGINT, lang STRING, text STRING"
    jsonl.write_jsonl(fx.table("documents").select("doc_id", "lang", "text"), path)
    rows = jsonl.scan_jsonl(fx.spark, path, schema).where("doc_id % 3 = 0")
    jsonl.write_jsonl(rows.withColumn("lang", F.upper("lang")).drop("ord"), path)
    return jsonl.scan_jsonl(fx.spark, path, schema).select(
        "doc_id", "lang", F.md5("text").alias("digest")
    )


@check(
    "a10_write_document",
    with_views("runs") + """
SELECT run_id, model, coalesce(reasoning_effort, '-') AS reasoning_effort FROM fx_runs""",
)
def a10_write_document(fx: Fixtures):
    path = scratch_path(fx.spark, "document")
    rows = F.array_sort(F.collect_list(F.struct("run_id", "model", "reasoning_effort")))
    documents.write_document(fx.runs.agg(rows.alias("runs")), path)
    doc = (
        fx.spark.read.schema("runs ARRAY<STRUCT<run_id: STRING, model: STRING, reasoning_effort: STRING>>")
        .option("multiLine", True)
        .json(path)
    )
    return doc.select(F.inline("runs")).select(
        "run_id", "model", F.coalesce("reasoning_effort", F.lit("-")).alias("reasoning_effort")
    )


@check(
    "a11_run_partitions",
    with_views("outputs") + """
SELECT concat(replace(model, '/', '_'), CASE WHEN z % 2 = 1 THEN '_temp0.7' ELSE '' END,
              CASE WHEN reasoning_enabled THEN '_reasoning-high' ELSE '' END) AS run_id,
       ord, riddle_id
FROM fx_outputs""",
)
def a11_run_partitions(fx: Fixtures):
    folder = scratch_path(fx.spark, "runs")
    out = fx.outputs.withColumn("temperature", F.when(F.col("z") % 2 == 1, 0.7).otherwise(0.0))
    named = out.withColumn(
        "run_id", run_name(F.upper("model"), "temperature", "reasoning_enabled", "reasoning_effort")
    )
    fields = [c for c in OUTPUT_FIELDS if c in named.columns]
    documents.write_runs(named.select("run_id", "ord", *fields), folder)
    return documents.scan_run_partitions(fx.spark, folder).select("run_id", "ord", "riddle_id")


@check("a12_snapshot", "SELECT doc_id, lang FROM documents")
def a12_snapshot(fx: Fixtures):
    folder = scratch_path(fx.spark, "backup")
    path = documents.snapshot(
        fx.table("documents").select("doc_id", "lang"), folder, "20240101_000000"
    )
    return jsonl.scan_jsonl(fx.spark, path, "doc_id BIGINT, lang STRING").drop("ord")


RELEASED = (
    with_views("entries") + """
SELECT id, original_riddle, original_answer, md5(altered_riddle) AS digest, altered_answer,
       coalesce(type, '-') AS type
FROM fx_entries"""
)


def _released(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "original_riddle",
        "original_answer",
        F.md5("altered_riddle").alias("digest"),
        "altered_answer",
        F.coalesce("type", F.lit("-")).alias("type"),
    )


@check("a13_release_export", RELEASED)
def a13_release_export(fx: Fixtures):
    source = scratch_path(fx.spark, "entries")
    target = scratch_path(fx.spark, "release")
    fx.entries.withColumnRenamed("set_name", "set").drop("ord").write.json(source)
    released = documents.release_export(fx.spark, source, target)
    if "set" in released.columns:
        raise AssertionError("the release holds a private column")
    return _released(jsonl.scan_jsonl(fx.spark, target, schemas.RAW))


@check("x16_release_export", RELEASED)
def x16_release_export(fx: Fixtures):
    return a13_release_export(fx)
