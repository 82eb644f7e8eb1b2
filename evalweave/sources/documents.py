"""Nested result documents, source lists, run folders, snapshots and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evalweave import schemas
from evalweave.functions.text import SMOKE_TEST, strip
from evalweave.operators.ordering import zero_based_index
from evalweave.operators.quality import release_columns
from evalweave.sources.jsonl import parsed_lines, struct_of, typed_rows
from evalweave.sources.textlines import numbered_lines, path_exists, stem



def scan_source_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, riddle_idx, riddle, answer) of a headed text file, cut at the last comma.

    Lines without a comma or with an empty side drop out; the index counts kept rows. A
    missing file gives no rows.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(schemas.SOURCE_ITEMS))
    line = strip("value")
    answer = F.substring_index(line, ",", -1)
    riddle = F.left(line, F.length(line) - F.length(answer) - 1)
    rows = (
        numbered_lines(spark, path)
        .where((F.col("line_no") > 1) & (F.instr(line, ",") > 0))
        .select("ord", strip(riddle).alias("riddle"), strip(answer).alias("answer"))
        .where("riddle <> '' AND answer <> ''")
    )
    return zero_based_index(rows).select("ord", "riddle_idx", "riddle", "answer")


def scan_runs(spark: SparkSession, folder: str, schema: str = schemas.MODEL_OUTPUTS) -> DataFrame:
    """All runs of a folder, one ``<run>.jsonl`` each; smoke tests are excluded.

    A run may also be a folder of that name with part files. A single run can be given by
    its own path.
    """
    path = folder if folder.rstrip("/").endswith(".jsonl") else f"{folder.rstrip('/')}/*.jsonl"
    named = numbered_lines(spark, path, run_id=stem("jsonl"))
    return typed_rows(
        parsed_lines(named.where(~F.col("run_id").contains(SMOKE_TEST))),
        schema,
        keep=("ord", "run_id"),
    )


def scan_run_partitions(
    spark: SparkSession, folder: str, schema: str = schemas.MODEL_OUTPUTS
) -> DataFrame:
    """As ``scan_runs`` for a folder written by ``write_runs``: one sub-folder per run.

    Malformed lines are skipped.
    """
    fields = StructType([*struct_of(schema).fields, StructField("ord", LongType())])
    lines = spark.read.schema("value string, run_id string").text(folder)
    rows = typed_rows(
        parsed_lines(lines.where(~F.col("run_id").contains(SMOKE_TEST))), fields, keep=("run_id",)
    )
    return rows.select(*fields.names, "run_id")


def write_runs(outputs: DataFrame, folder: str) -> None:
    """Append outputs below ``run_id=<name>`` sub-folders."""
    outputs.write.mode("append").partitionBy("run_id").json(folder)


def scan_solver_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Sanity answers with one solver label per file: its first row's, else the file stem.

    ``solver_ord`` is the position of the file's first line.
    """
    lines = numbered_lines(spark, f"{folder.rstrip('/')}/*.jsonl", stem=stem("jsonl"))
    rows = typed_rows(parsed_lines(lines), schemas.SANITY_ANSWERS, keep=("ord", "stem"))
    labels = rows.groupBy("stem").agg(
        F.coalesce(F.min_by("solver", "ord"), F.first("stem")).alias("solver"),
        F.min("ord").alias("solver_ord"),
    )
    return rows.drop("solver").join(labels, "stem").drop("stem")


def scan_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated runs: ``all_results.json`` if present, else every ``*_eval.json``.

    One row per document with ``run_id``: the document's own one, else the name of its file,
    else the load order. Documents with the same run id are parts of one run; they share
    ``run_ord``, the load order of the first, and ``part_ord`` numbers them from 1 by
    ``part``, then load order.
    """
    whole = f"{folder.rstrip('/')}/all_results.json"
    fields = struct_of(schemas.EVAL_RESULTS).add("run_id", "string").add("part", "long")
    reader = spark.read.schema(fields).option("multiLine", True)
    if path_exists(spark, whole):
        docs = reader.json(whole)
    else:
        docs = reader.json(f"{folder.rstrip('/')}/*_eval.json")
    # A document is read by one task, in order; files are ordered by name.
    placed = docs.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("_id"),
    )
    name = F.nullif(F.regexp_replace(stem("json"), "_eval$", ""), F.lit("all_results"))
    same_run = Window.partitionBy("run_id")
    # One row per document, so one task numbers them; the details stay out of it.
    order = (
        placed.select("path", "_id", "part", F.coalesce("run_id", F.nullif(name, F.lit(""))).alias("_own"))
        .withColumn("_n", F.row_number().over(Window.orderBy("path", "_id")).cast("long"))
        .withColumn(
            "run_id", F.coalesce("_own", F.concat(F.lit("run_"), F.col("_n").cast("string")))
        )
        .withColumns(
            {
                "run_ord": F.min("_n").over(same_run),
                "part_ord": F.row_number().over(same_run.orderBy("part", "_n")).cast("long"),
            }
        )
        .drop("_own", "_n", "part")
    )
    return placed.drop("run_id").join(order, ["path", "_id"]).drop("path", "_id")


def evaluation_details(docs: DataFrame) -> DataFrame:
    """Flat details of evaluated runs; ``ord`` counts a run's samples over all its parts."""
    parts = docs.select("run_id", "run_ord", "part_ord", F.size("details").alias("_size"))
    earlier = (
        Window.partitionBy("run_id").orderBy("part_ord").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        "run_id", "part_ord",
        F.coalesce(F.sum(F.greatest("_size", F.lit(0))).over(earlier), F.lit(0)).alias("_start"),
    )
    return (
        docs.join(starts, ["run_id", "part_ord"])
        .select("run_id", "run_ord", "_start", F.posexplode("details").alias("_pos", "_d"))
        .select("run_id", "run_ord", (F.col("_start") + F.col("_pos")).alias("ord"), "_d.*")
    )


def scan_sanity_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Per-item rows of a sanity report; None when there is no report, meaning no filter."""
    if not path_exists(spark, path):
        return None
    doc = spark.read.schema(struct_of(schemas.SANITY_RESULTS)).option("multiLine", True).json(path)
    return doc.select(F.inline("per_riddle"))


def write_document(df: DataFrame, path: str) -> None:
    """Write a result as one JSON document per row; small by nature (a report, a leaderboard)."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    df.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, folder: str, part: str = "part") -> None:
    """Write one JSON document per row, each in a file of its own below ``<part>=<value>``."""
    text = F.to_json(F.struct(*[c for c in df.columns if c != part]), {"ignoreNullFields": "false"})
    rows = df.select(part, text.alias("value")).repartition(part)
    rows.write.partitionBy(part).mode("overwrite").text(folder)


def scan_type_document(spark: SparkSession, path: str) -> DataFrame:
    """The types of a stored type document, with ``generated_at`` on every row."""
    doc = spark.read.schema(struct_of(schemas.TYPE_DOCUMENT)).option("multiLine", True).json(path)
    return doc.select("generated_at", F.inline("types"))


def snapshot(table: DataFrame, folder: str, stamp: str) -> str:
    """Copy a table to ``<folder>/benchmark_<stamp>`` before it is replaced."""
    path = f"{folder.rstrip('/')}/benchmark_{stamp}"
    table.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return path


def release_export(
    spark: SparkSession, source: str, target: str, schema: str = schemas.ENTRIES
) -> DataFrame:
    """Write the public keys of an entries file and return the written rows.

    Values of any type are kept, null ones too; absent keys stay absent. A malformed line
    fails the job.
    """
    lines = spark.read.text(source).where(F.col("value").rlike(r"\S"))
    item = F.from_json("value", "map<string,variant>", {"mode": "FAILFAST"})
    public = F.map_filter(item, lambda key, _: key.isin(*schemas.RELEASE_COLUMNS))
    lines.select(F.to_json(public).alias("value")).write.mode("overwrite").text(target)
    return release_columns(spark.read.schema(struct_of(schema)).json(target))
