"""Draws by chunk, group keys, stored runs, and plans without sorted aggregates."""

import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.functions.draws import MASK, MIX_A, MIX_B
from evalweave.operators import bootstrap, coverage, metrics, quality, resume
from evalweave.plans import evaluation
from evalweave.sources import documents

SCORES = "run STRING, cluster STRING, score DOUBLE"


def mix(x):
    x ^= x >> 16
    x = x * MIX_A & MASK
    x ^= x >> 15
    x = x * MIX_B & MASK
    return x ^ x >> 15


def plain_bounds(rows, key, replicates, chunk):
    """Lower and upper bound of one group, draw by draw."""
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    sums = {}
    for _, cluster, score in rows:
        s, n = sums.get(cluster, (0, 0))
        sums[cluster] = (s + round(score * 10**9), n + 1)
    table = [sums[c] for c in sorted(sums, key=lambda c: (int(md5(c)[:15], 16), c))]
    k, seed = len(table), int(md5(f"42|{len(key)}:{key}")[:8], 16)
    means = []
    for b in range(replicates):
        base, s, n = mix((seed + b) & MASK), 0, 0
        if k <= chunk:
            counts = {0: k}
        else:
            counts = {}
            for i in range(k):
                c = mix(base ^ mix(i)) % k // chunk
                counts[c] = counts.get(c, 0) + 1
        for c, draws in counts.items():
            start = base if k <= chunk else base ^ mix(c + 1)
            part = table[c * chunk : (c + 1) * chunk]
            for j in range(draws):
                row = part[mix(start ^ mix(j)) % len(part)]
                s, n = s + row[0], n + row[1]
        means.append(s / n / 1e9)
    means.sort()
    return means[int(replicates * 0.025)], means[int(replicates * 0.975)]


@pytest.mark.parametrize("chunk", [4096, 37, 5, 1])
def test_draws_by_chunk(spark, chunk):
    rng = random.Random(chunk)
    rows = [(f"r{i % 2}", f"c{i % 37}", rng.random()) for i in range(400)]
    scores = spark.createDataFrame(rows, SCORES)
    got = bootstrap.bootstrap_bounds(scores, ["run"], 60, chunk=chunk).collect()
    for r in got:
        own = [row for row in rows if row[0] == r["run"]]
        assert (r["lo"], r["hi"]) == pytest.approx(plain_bounds(own, r["run"], 60, chunk))
    assert len(got) == 2


def test_group_keys_do_not_collide(spark):
    keys = [("a|b", "c", 0.0), ("a", "b|c", 1.0), (None, "c", 0.25), ("", "c", 0.5)]
    rows = [(a, b, f"c{i}", v) for a, b, v in keys for i in range(8)]
    scores = spark.createDataFrame(rows, "x STRING, y STRING, cluster STRING, score DOUBLE")
    got = bootstrap.bootstrap_bounds(scores, ["x", "y"], 50).collect()
    assert {(r["x"], r["y"]): (r["lo"], r["hi"]) for r in got} == {
        (a, b): (v, v) for a, b, v in keys
    }


def stored(spark, folder, max_samples):
    rng = random.Random(3)
    entries = spark.createDataFrame(
        [(i, f"alt_{i}", f"original {i}", f"answer {i}") for i in range(12)],
        "ord BIGINT, id STRING, original_riddle STRING, original_answer STRING",
    )
    rows, verdicts = [], []
    for run in range(3):
        for i in range(12):
            for kind, samples in (("altered", 3), ("original", 1)):
                for s in range(1, samples + 1):
                    rows.append((len(rows), f"run_{run}", f"alt_{i}", kind, s, f"m{run}"))
                    verdicts.append(
                        (len(rows), f"run_{run}", f"alt_{i}", kind, s, rng.random() < 0.7, rng.random() < 0.3)
                    )
    outputs = spark.createDataFrame(
        rows, "ord BIGINT, run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT, model STRING"
    ).withColumns(
        {
            "model_answer": F.lit("x"), "provider": F.lit("p"), "quantization": F.lit(""),
            "reasoning_enabled": F.lit(False), "reasoning_effort": F.lit(None).cast("string"),
            "input_tokens": F.lit(2).cast("long"), "output_tokens": F.lit(3).cast("long"),
        }
    )
    judged = spark.createDataFrame(
        verdicts,
        "ord BIGINT, run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT, c BOOLEAN, g BOOLEAN",
    ).withColumn("judgment", F.expr("struct(c AS correct, g AS gave_original, false AS competing)"))
    result = evaluation.evaluate_runs(outputs, judged.drop("c", "g"), entries)
    docs = result.documents(max_samples)
    named = docs.withColumn("name", F.expr("concat(run_id, '_', part, '_eval.json')"))
    named.write.partitionBy("name").json(folder)
    return result, entries, documents.scan_evaluations(spark, folder)


@pytest.mark.parametrize("max_samples, parts", [(1000, 1), (7, 7)])
def test_stored_runs_stay_whole(spark, tmp_path, max_samples, parts):
    result, entries, found = stored(spark, str(tmp_path / "evals"), max_samples)
    assert found.count() == 3 * parts
    again = evaluation.evaluation_from_documents(found)
    wanted = evaluation.leaderboard(result, entries, replicates=50).collect()
    assert evaluation.leaderboard(again, entries, replicates=50).collect() == wanted
    assert [r["rank"] for r in wanted] == [1, 2, 3]
    ords = [r["ord"] for r in again.details.where("run_id = 'run_1'").orderBy("ord").collect()]
    assert ords == list(range(48))


def test_large_aggregates_hash(spark):
    details = spark.createDataFrame(
        [],
        "run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT, ord BIGINT, "
        "correct BOOLEAN, gave_original_answer BOOLEAN",
    )
    judged = spark.createDataFrame(
        [],
        "run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT, ord BIGINT, "
        "judgment STRUCT<correct: BOOLEAN, gave_original: BOOLEAN, competing: BOOLEAN>",
    )
    for df in (metrics.item_sums(details), resume.with_judgments(details.drop("correct"), judged)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    outputs = details.selectExpr(
        "run_id", "ord", "'m' AS model", "'p' AS provider", "'' AS quantization",
        "true AS reasoning_enabled", "riddle_type AS reasoning_effort",
    )
    plan = quality.run_metadata(outputs)._jdf.queryExecution().executedPlan().toString()
    # From the scan up to the first shuffle, every aggregate is a hashed one.
    assert "SortAggregate" not in plan.split("Exchange")[-1]


def test_stored_documents_share_files(spark, monkeypatch):
    """Several documents stand in a file, in order; none is lost or merged."""
    from evalweave.checks import source_checks
    from evalweave.checks.fixtures import Fixtures

    monkeypatch.setattr(source_checks, "DOCUMENTS", 2)
    seen = []
    scan = documents.scan_evaluations
    monkeypatch.setattr(documents, "scan_evaluations", lambda s, folder: seen.append(folder) or scan(s, folder))
    ids = spark.range(2000).select(F.col("id").alias("doc_id"))
    held = {
        "documents": ids.selectExpr("doc_id", "concat('t', doc_id) AS text", "'en' AS lang", "'web' AS source", "doc_id * 3 AS n_chars"),
        "events": ids.selectExpr("doc_id AS event_id", "doc_id AS user_id", "'view' AS event_type", "doc_id / 100 AS value"),
    }
    monkeypatch.setattr(Fixtures, "table", lambda self, name: held[name])
    fx = Fixtures(spark, "none")
    made = source_checks.evaluation_of(fx)
    monkeypatch.setattr(source_checks, "evaluation_of", lambda fx: made)
    found = source_checks.stored_evaluations(fx)
    wanted = made.documents(max_samples=1000)
    parts = {(r["run_id"], r["part"]) for r in wanted.select("run_id", "part").collect()}
    got = [(r["run_id"], r["part"], r["part_ord"]) for r in found.select("run_id", "part", "part_ord").collect()]
    assert len(got) == len(parts) == 18 and {(r, p) for r, p, _ in got} == parts
    files = spark.read.text(f"{seen[0]}/*_eval.json").count()
    assert files == 12
    columns = ["run_id", "riddle_id", "riddle_type", "sample_index", "model_answer", "correct"]
    again, details = documents.evaluation_details(found).select(*columns), made.details.select(*columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, details.collect()))


def test_documents_of_a_run_meet_in_no_join(spark, tmp_path):
    """Summaries are sent to the parts, and files are written a row per document, in order of the parts."""
    from evalweave.checks import source_checks

    summary = spark.createDataFrame([("run_0", 1), ("bare", 2), (None, 3)], "run_id string, model int")
    for c in ["provider", "quantization", "reasoning_enabled", "reasoning_effort", *evaluation._SUMMARY]:
        summary = summary.withColumn(c, F.lit(0))
    details = spark.range(130).selectExpr(
        "id AS ord", "CASE WHEN id < 128 THEN 'run_0' END AS run_id", "concat('alt_', id) AS riddle_id", "'altered' AS riddle_type",
        "1 AS sample_index", "'a' AS model_answer", "true AS correct", "false AS gave_original_answer", "'o' AS original_answer",
    )
    docs = evaluation.Evaluation(summary, details, details).documents(max_samples=3)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r["run_id"], r["part"]): r["details"] for r in docs.collect()}
    assert set(got) == {("run_0", p) for p in range(43)} | {("bare", 0), (None, 0)}
    assert got["bare", 0] is None and got[None, 0] is None
    assert [d["riddle_id"] for p in range(43) for d in got["run_0", p]] == [f"alt_{k}" for k in range(128)]

    folder = str(tmp_path / "evals")
    source_checks.write_evaluations(docs, folder)
    files = {name: spark.read.text(f"{folder}/name={name}").collect() for name in ("run_0_0_eval.json", "run_0_1_eval.json", "bare_0_eval.json")}
    parts = {name: [d["part"] for d in json.loads(line["value"])] for name, [line] in files.items()}
    assert parts == {"run_0_0_eval.json": [*range(32)], "run_0_1_eval.json": [*range(32, 43)], "bare_0_eval.json": [0]}
    found = documents.scan_evaluations(spark, folder)
    again = documents.evaluation_details(found).where("run_id = 'run_0'").orderBy("ord").collect()
    assert [r["riddle_id"] for r in again] == [f"alt_{k}" for k in range(128)]


@pytest.mark.parametrize("size, block", [(1 << 20, 1 << 15), (64, 16), (50, 7)])
def test_draws_in_blocks(monkeypatch, size, block):
    """Blocks and ranges give the draws that single steps give, in 32-bit arithmetic."""
    monkeypatch.setattr(bootstrap, "_RANGE", size)
    monkeypatch.setattr(bootstrap, "_BLOCK", block)
    assert bootstrap._mix(np.arange(9, dtype=np.uint32)).dtype == np.uint32
    k, chunk, base = 203, 10, 0xFEDCBA98
    rows = [(3, k, 5, base, r) for r in range(-(-k // size))] + [(4, 7, 6, 11, 0)]
    batch = pd.DataFrame(rows, columns=["g", "k", "b", "base", "r"])
    got = pd.concat(bootstrap._chunk_counter(chunk)([batch])).groupby(["g", "c", "b", "start"])["n"].sum()
    wanted = {(4, 0, 6, 11): 7}
    for i in range(k):
        c = mix(base ^ mix(i)) % k // chunk
        key = (3, c, 5, base ^ mix(c + 1))
        wanted[key] = wanted.get(key, 0) + 1
    assert got.to_dict() == wanted
    clusters = pd.DataFrame({"idx": [2, 0, 1], "s": [-5 * 10**17, 3, 10**17], "n": [1, 2, 3]})
    counts = pd.DataFrame({"g": 3, "b": [0, 1], "start": [base, 7], "draws": [40, 3]})
    sums = bootstrap._drawn_sums(counts, clusters)
    table = [(3, 2), (10**17, 3), (-5 * 10**17, 1)]
    for row, (start, draws) in zip(sums.itertuples(), [(base, 40), (7, 3)], strict=True):
        drawn = [table[mix(start ^ mix(j)) % 3] for j in range(draws)]
        assert (row.s, row.n) == tuple(map(sum, zip(*drawn, strict=True)))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_summed_once(spark, monkeypatch):
    """The index of the clusters reads stored sums; tiles of runs are not worked through twice."""
    stored, materialise = {}, bootstrap.materialise
    monkeypatch.setattr(
        bootstrap, "materialise", lambda df, label: stored.update({label: plan_of(df)}) or materialise(df, label)
    )
    rows = [(f"run_{r}", f"i{i}", f"c{i % 6}", True, r / 2) for r in range(2) for i in range(12)]
    items = spark.createDataFrame(
        rows, "run_id STRING, riddle_id STRING, cluster STRING, original_solved BOOLEAN, override_mean DOUBLE"
    )
    board = spark.createDataFrame([("run_0", 1), ("run_1", 2)], "run_id STRING, rank INT")
    assert bootstrap.pair_signs(items, board, 40).first()["sign"] == 1
    assert sum(plan.count("FlatMapGroupsInPandas") for plan in stored.values()) == 1
    assert "FlatMapGroupsInPandas" not in stored["clusters"]


def test_samples_are_read_once(spark, monkeypatch):
    """Evaluation reads the samples once for each side of the join and once for the runs."""
    from evalweave.checks import source_checks
    from evalweave.checks.fixtures import Fixtures

    ids = spark.range(300).select(F.col("id").alias("doc_id"))
    empty = F.when(F.col("doc_id") % 50 != 7, F.col("doc_id"))
    held = {
        "documents": ids.selectExpr("doc_id", "concat('t', doc_id) AS text", "'en' AS lang", "'web' AS source", "doc_id * 3 AS n_chars"),
        "events": ids.select("doc_id", empty.alias("event_id")).selectExpr(
            "event_id", "if(doc_id % 40 = 3, NULL, doc_id) AS user_id", "if(doc_id % 9 = 1, 'signup', 'view') AS event_type",
            "if(doc_id % 60 = 5, NULL, doc_id / 100) AS value"
        ),
    }
    monkeypatch.setattr(Fixtures, "table", lambda self, name: held[name])
    fx = Fixtures(spark, "none")
    assert plan_of(fx.judgments).count("Window") == 1
    # Only samples of events are numbered, and their texts are made afterwards.
    below = plan_of(fx.outputs).split("Window [", 1)[1].splitlines()[1]
    assert "Project [" in below and "run_" not in below
    first = fx.outputs.where("sample_index IS NOT NULL").count()
    z28 = fx.outputs.where("z <> 28").count() + fx.outputs.where("z % 9 = 4").count()
    assert first == fx.outputs.count() and fx.judgments.count() == z28
    stored, materialise = {}, evaluation.materialise
    monkeypatch.setattr(
        evaluation, "materialise", lambda df, label: stored.update({label: plan_of(df)}) or materialise(df, label)
    )
    made = source_checks.evaluation_of(fx)
    assert stored["items"].count("Window") == 2
    # The summary reads stored kinds of runs.
    assert "Range" not in plan_of(made.summary) and set(stored) == {"items", "run_kinds"}
    same = metrics.item_sums(made.details)
    assert made.items.columns == same.columns
    assert sorted(map(str, made.items.collect())) == sorted(map(str, same.collect()))
    tokens = {tuple(r) for r in metrics.token_totals(fx.outputs).collect() if r["run_id"]}
    assert {tuple(r) for r in made.summary.select("run_id", "total_input_tokens", "total_output_tokens").collect()} == tokens
    meta = [c for c in quality.checked_run_metadata(fx.outputs).columns]
    wanted = quality.checked_run_metadata(fx.outputs).where("run_id IS NOT NULL").collect()
    assert sorted(map(str, made.summary.select(*meta).collect())) == sorted(map(str, wanted))


def test_coverage_of_unique_rows(spark):
    entries = spark.createDataFrame(
        [(0, "a", "o"), (1, "b", "o"), (2, "", "p"), (3, None, "p")], "ord BIGINT, id STRING, original_riddle STRING"
    )
    rows = [("r1", "altered", "a"), ("r1", "altered", "b"), ("r1", "original", "a"), ("r1", "altered", ""),
            ("r2", "altered", "a"), ("r2", "original", "b"), ("r2", "altered", None), (None, "altered", "a")]
    details = spark.createDataFrame(rows, "run_id STRING, riddle_type STRING, riddle_id STRING")
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id STRING")
    plain, unique = (
        sorted(map(tuple, coverage.coverage_report(runs, details, entries, u).collect())) for u in (False, True)
    )
    assert plain == unique == [("r1", 2, 0, 1, 0), ("r2", 2, 1, 1, 1), ("r3", 2, 2, 1, 1)]
    assert coverage.complete_runs(runs, details, entries, unique=True).collect() == [("r1",)]
