"""Queries for scalar functions and for the incremental paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.checks.fixtures import Fixtures, with_views
from evalweave.checks.metric_checks import r4
from evalweave.checks.registry import check, joined
from evalweave.checks.source_checks import RELEASED, _released
from evalweave.functions import answers as ans
from evalweave.functions import text as txt
from evalweave.operators import quality, resume
from evalweave.session import scratch_path
from evalweave.sources.jsonl import append_jsonl
from evalweave.streaming.incremental import append_arrivals, append_handled, append_unseen, arriving_jsonl, keyed_once

WS = "concat(' ', chr(9), chr(10), chr(13))"


@check("b1_release_columns", RELEASED)
def b1_release_columns(fx: Fixtures):
    return _released(quality.release_columns(fx.entries))


@check("h1_text_key", f"SELECT doc_id, md5(lower(trim(text, {WS}))) AS digest FROM documents")
def h1_text_key(fx: Fixtures):
    return fx.table("documents").select("doc_id", F.md5(txt.text_key("text")).alias("digest"))


@check(
    "h5_safe_name",
    "SELECT page_id, replace(replace(replace(url, '/', '_'), ':', '_'), chr(92), '_') AS name FROM pages",
)
def h5_safe_name(fx: Fixtures):
    return fx.table("pages").select("page_id", txt.safe_name("url").alias("name"))


# Four proposed answers per document; some equal each other or the answer.
PROPOSED = """
docs AS (SELECT doc_id, lang, source, concat(' ', upper(lang)) AS p1, source AS p2, '' AS p3,
                concat(source, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '!' END) AS p4 FROM documents)"""


def _proposed(fx: Fixtures):
    return fx.table("documents").withColumn(
        "proposed",
        F.when(
            F.col("doc_id") % 7 != 0,
            F.array(
                F.concat(F.lit(" "), F.upper("lang")),
                F.col("source"),
                F.lit(""),
                F.concat("source", F.when(F.col("doc_id") % 2 == 0, " ").otherwise("!")),
            ),
        ),
    )


@check(
    "h12_accepted_answers",
    "WITH " + PROPOSED + """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 2 = 0 THEN concat(lang, '|', source)
               ELSE concat(lang, '|', source, '|', p4) END AS accepted FROM docs""",
)
def h12_accepted_answers(fx: Fixtures):
    return _proposed(fx).select(
        "doc_id", joined(ans.accepted_answers("lang", "proposed"), "accepted")
    )


@check(
    "h13_competing_answers",
    "WITH " + PROPOSED + """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(p1, '|', p3, CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('|', p4) END) END AS competing
FROM docs""",
)
def h13_competing_answers(fx: Fixtures):
    return _proposed(fx).select(
        "doc_id", joined(ans.competing_answers("proposed", F.upper("source")), "competing")
    )


@check(
    "h14_comma_list",
    f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: trim(p, {WS})), lambda p: p <> ''), '|'), '') AS parts
FROM documents""",
)
def h14_comma_list(fx: Fixtures):
    return fx.table("documents").select("doc_id", joined(ans.comma_list("text"), "parts"))


@check(
    "h16_solver_parts",
    """SELECT page_id, split_part(url, ':', 1) AS provider, coalesce(nullif(substr(url, instr(url, ':') + 1), ''), '-') AS model FROM pages""",
)
def h16_solver_parts(fx: Fixtures):
    parts = txt.solver_parts("url")
    return fx.table("pages").select(
        "page_id", parts["provider"].alias("provider"), F.coalesce(parts["model"], F.lit("-")).alias("model")
    )


@check(
    "h17_without_org",
    "SELECT page_id, substr(url, instr(url, '/') + 1) AS name FROM pages",
)
def h17_without_org(fx: Fixtures):
    return fx.table("pages").select("page_id", txt.without_org("url").alias("name"))


@check(
    "h18_numbered_ids",
    "SELECT l_orderkey, l_linenumber, printf('alt_%04d', l_orderkey) AS id, l_orderkey AS number FROM lineitem",
)
def h18_numbered_ids(fx: Fixtures):
    rows = fx.table("lineitem").withColumn("id", txt.numbered_id("alt_", F.col("l_orderkey")))
    return rows.select("l_orderkey", "l_linenumber", "id", txt.id_number("id").alias("number"))


@check(
    "h22_previews",
    "SELECT doc_id, concat(left(text, 55), CASE WHEN length(text) > 55 THEN '...' ELSE '' END) AS preview FROM documents",
)
def h22_previews(fx: Fixtures):
    """The preview is the feature; the full text stays in its table."""
    return fx.table("documents").select("doc_id", txt.preview("text").alias("preview"))


@check(
    "h23_utc_timestamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS record, strftime(ts, '%Y%m%d_%H%M%S') AS snap,
              strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS report FROM events""",
)
def h23_utc_timestamps(fx: Fixtures):
    # The stored times have no zone; they are taken as UTC whatever the session's zone is.
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return fx.table("events").select(
        "event_id", txt.record_time(ts).alias("record"), txt.snapshot_time(ts).alias("snap"),
        txt.report_time(ts).alias("report"),
    )


@check(
    "h24_four_decimals",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r4('(l_orderkey % 32) / 32')} AS a, {r4('(l_partkey % 20000) / 20000')} AS b,
               {r4('coalesce((l_suppkey % 7) / nullif(l_linenumber % 3, 0) / 10, 0.0)')} AS c FROM lineitem""",
)
def h24_four_decimals(fx: Fixtures):
    ok, pk = F.col("l_orderkey") % 32, F.col("l_partkey") % 20000
    c = txt.ratio(F.col("l_suppkey") % 7, F.col("l_linenumber") % 3) / 10
    return fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        txt.round4(ok / 32).alias("a"), txt.round4(pk / 20000).alias("b"), txt.round4(c).alias("c"),
    )


@check(
    "h27_percentages",
    """SELECT o_orderkey, concat(printf('%d.%d', n // 10, n % 10), '%') AS share, concat('+/-', printf('%d.%d', n // 10, n % 10), '%') AS half
       FROM (SELECT o_orderkey, CAST(o_custkey % 1001 AS BIGINT) AS n FROM orders) q""",
)
def h27_percentages(fx: Fixtures):
    share = (F.col("o_custkey") % 1001) / 1000
    return fx.table("orders").select(
        "o_orderkey", txt.percent(share).alias("share"), txt.plus_minus(share).alias("half")
    )


# ── incremental ───────────────────────────────────────────────────────

STREAM_FIELDS = (
    "run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT, ord BIGINT, raw STRING"
)
STREAM_KEY = ["run_id", "riddle_id", "riddle_type", "sample_index"]


def _arrivals(fx: Fixtures) -> str:
    """Outputs as JSONL files; samples with z below 10 are delivered again later."""
    folder = scratch_path(fx.spark, "arrivals")
    body = F.to_json(F.struct(F.col("model_answer").alias("answer")))
    rows = fx.outputs.select(*STREAM_KEY, "ord", body.alias("raw"), "z")
    append_jsonl(rows.drop("z").repartition(4), folder)
    append_jsonl(rows.where("z < 10").drop("z").repartition(2), folder)
    return folder


ONCE = """
SELECT DISTINCT run_id, riddle_id, riddle_type, sample_index, model_answer AS answer FROM fx_outputs"""


@check("i1_incremental_resume", with_views("outputs") + ONCE)
def i1_incremental_resume(fx: Fixtures):
    """Runs the stream twice over the same files under fresh checkpoints: nothing is added."""
    from evalweave.functions.parsing import parsed_answer

    folder, target = _arrivals(fx), scratch_path(fx.spark, "target")

    def parse(batch):
        return batch.withColumn("answer", parsed_answer("raw")["answer"]).drop("raw")

    for _ in range(2):
        stream = arriving_jsonl(fx.spark, folder, STREAM_FIELDS, max_files=3)
        append_unseen(
            stream, target, STREAM_KEY, scratch_path(fx.spark, "cp"), parse, order="ord"
        ).awaitTermination()
    return fx.spark.read.parquet(target).select(*STREAM_KEY, "answer")


@check(
    "i2_arrival_order_append",
    with_views("outputs") + """
SELECT run_id, riddle_id, riddle_type, sample_index, model_answer AS answer FROM fx_outputs
UNION ALL SELECT run_id, riddle_id, riddle_type, sample_index, model_answer FROM fx_outputs WHERE z < 10""",
)
def i2_arrival_order_append(fx: Fixtures):
    from evalweave.functions.parsing import parsed_answer

    target = scratch_path(fx.spark, "target")
    stream = arriving_jsonl(fx.spark, _arrivals(fx), STREAM_FIELDS, max_files=2)
    append_arrivals(
        stream, target, scratch_path(fx.spark, "cp"),
        lambda rows: rows.withColumn("answer", parsed_answer("raw")["answer"]).drop("raw"),
    ).awaitTermination()
    return fx.spark.read.parquet(target).select(*STREAM_KEY, "answer")


def _handled(row) -> dict:
    """Stands in for a callback: fails on every seventh row."""
    if row["ord"] % 7 == 0:
        raise ValueError(f"no answer for {row['ord']}")
    return {"ord": row["ord"], "size": len(row["run_id"])}


@check(
    "i2_failed_rows",
    with_views("outputs") + """,
twice AS (SELECT ord, run_id FROM fx_outputs UNION ALL SELECT ord, run_id FROM fx_outputs WHERE z < 10)
SELECT ord, CASE WHEN ord % 7 = 0 THEN concat('ValueError: no answer for ', CAST(ord AS VARCHAR)) ELSE '-' END AS error,
       CASE WHEN ord % 7 = 0 THEN -1 ELSE length(run_id) END AS size FROM twice""",
)
def i2_failed_rows(fx: Fixtures):
    """Failed rows stand beside the good ones; together they are all that arrived."""
    target, failed = scratch_path(fx.spark, "target"), scratch_path(fx.spark, "failed")
    stream = arriving_jsonl(fx.spark, _arrivals(fx), STREAM_FIELDS, max_files=2)
    append_handled(
        stream, target, failed, scratch_path(fx.spark, "cp"), _handled, "ord BIGINT, size BIGINT"
    ).awaitTermination()
    good = fx.spark.read.parquet(target).select("ord", F.lit("-").alias("error"), "size")
    bad = fx.spark.read.parquet(failed).select("ord", "error", F.lit(-1).cast("long").alias("size"))
    return good.union(bad)


@check(
    "i3_keyed_once",
    with_views("outputs") + "\nSELECT DISTINCT run_id, riddle_id, riddle_type, sample_index FROM fx_outputs",
)
def i3_keyed_once(fx: Fixtures):
    target = scratch_path(fx.spark, "target")
    stream = arriving_jsonl(fx.spark, _arrivals(fx), STREAM_FIELDS, max_files=3)
    append_arrivals(
        keyed_once(stream, STREAM_KEY), target, scratch_path(fx.spark, "cp")
    ).awaitTermination()
    return fx.spark.read.parquet(target).select(*STREAM_KEY)


@check(
    "i1_batch_resume",
    with_views("outputs") + """
SELECT ord FROM fx_outputs o WHERE NOT EXISTS (
  SELECT 1 FROM fx_outputs d WHERE d.z % 3 = 0 AND d.run_id = o.run_id AND d.riddle_id = o.riddle_id
    AND d.riddle_type = o.riddle_type AND d.sample_index = o.sample_index)""",
)
def i1_batch_resume(fx: Fixtures):
    out = fx.outputs
    return resume.without_done(out, out.where("z % 3 = 0"), resume.OUTPUT_KEY).select("ord")
