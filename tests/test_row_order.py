"""Row order over unions, tasks of united sets, and reruns with missing keys."""

import json

from evalweave import schemas
from evalweave.operators.ordering import union_in_order
from evalweave.plans.runs import build_tasks
from evalweave.sources.documents import scan_run_partitions, scan_runs
from evalweave.streaming.incremental import BUCKET, append_handled, append_unseen, stored_keys


def test_chained_unions_keep_order(spark):
    parts = [spark.createDataFrame([(0, f"{n}a"), (5, f"{n}b")], "ord long, id string") for n in "xyz"]
    both = union_in_order(union_in_order(parts[0], parts[1]), parts[2])
    found = [r["id"] for r in both.orderBy("ord").collect()]
    assert found == ["xa", "xb", "ya", "yb", "za", "zb"]
    assert len({r["ord"] for r in both.collect()}) == 6


def test_tasks_of_both_sets(spark):
    schema = "ord long, id string, original_riddle string, altered_riddle string"
    first = spark.createDataFrame([(0, "a1", "o1", "x1"), (1, "a2", "o2", "x2")], schema)
    second = spark.createDataFrame([(0, "f1", "o1", "y1")], schema)
    tasks = build_tasks(union_in_order(first, second), num_samples=2, temperature=1.0)
    rows = tasks.orderBy("ord").collect()
    assert [(r["riddle_id"], r["riddle_type"], r["sample_index"]) for r in rows] == [
        ("a1", "original", 1), ("a1", "altered", 1), ("a1", "altered", 2),
        ("a2", "original", 1), ("a2", "altered", 1), ("a2", "altered", 2),
        ("f1", "altered", 1), ("f1", "altered", 2),
    ]


def test_missing_sample_index_is_stored_once(spark, tmp_path):
    keys = ["run_id", "sample_index"]
    (tmp_path / "in").mkdir()
    line = json.dumps({"run_id": "r", "sample_index": None})
    schema = "run_id string, sample_index int"
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(line + "\n" + json.dumps({"run_id": None}) + "\n")
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        append_unseen(stream, str(tmp_path / "out"), keys, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_malformed_lines_of_run_partitions_are_skipped(spark, tmp_path):
    folder = tmp_path / "run_id=m"
    folder.mkdir()
    good = json.dumps({"riddle_id": "r1", "ord": 3})
    (folder / "part.json").write_text(good + "\n{broken\n")
    rows = scan_run_partitions(spark, str(tmp_path), schemas.MODEL_OUTPUTS).collect()
    assert [(r["run_id"], r["riddle_id"], r["ord"]) for r in rows] == [("m", "r1", 3)]


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """Redelivered keys count once over many appends, and the plan prunes the other buckets."""
    (tmp_path / "in").mkdir()
    target = str(tmp_path / "out")
    for n in range(3):
        lines = [json.dumps({"k": k, "n": n}) for k in range(n * 5, n * 5 + 10)]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema("k long, n long").json(str(tmp_path / "in"))
        append_unseen(stream, target, ["k"], str(tmp_path / "cp"), buckets=16).awaitTermination()
    rows = spark.read.parquet(target)
    assert sorted((r["k"], r["n"]) for r in rows.collect()) == [(k, max(0, (k - 5) // 5)) for k in range(20)]
    used = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    one = stored_keys(spark, target, ["k"], used[:1])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert one.count() == rows.where(rows[BUCKET] == used[0]).count() < 20


def test_failing_rows_do_not_end_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        lines = [json.dumps({"k": k if k % 4 else None, "t": "x" * k}) for k in range(n * 10, n * 10 + 10)]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))

    def handle(row):
        assert isinstance(row["k"], int) or row["k"] is None
        return {"k": 100 // (row["k"] % 3), "more": 1}  # fails on NULL and on multiples of 3

    stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("good", "bad", "cp")]
    append_handled(stream, *paths, handle, "k long, absent string").awaitTermination()
    good, bad = (spark.read.parquet(p).collect() for p in paths[:2])
    kept = [k for k in range(30) if k % 4 and k % 3]
    assert sorted(r["k"] for r in good) == sorted(100 // (k % 3) for k in kept)
    assert all(r["absent"] is None for r in good) and len(good) + len(bad) == 30
    assert {r["error"].split(":")[0] for r in bad} == {"TypeError", "ZeroDivisionError"}
    assert sorted(len(r["t"]) for r in bad) == [k for k in range(30) if k not in kept]


def test_ranked_rows_are_spread_over_tasks(spark):
    """100,000 consecutive rows are not one task's load; wide rows would be more than it holds."""
    from pyspark.sql import functions as F

    from evalweave.operators.ordering import global_rank

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = global_rank(spark.range(0, 100_000, 1, 4).withColumnRenamed("id", "ord"), "ord", name="n")
        loads = ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in loads) < 60_000
        assert ranked.where("n <> ord + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lines_of_runs_are_parsed_once_and_not_shuffled(spark, tmp_path):
    lines = [json.dumps({"riddle_id": f"alt_{i}", "sample_index": "no" if i == 2 else i}) for i in range(4)]
    (tmp_path / "run_1.jsonl").write_text("\n".join([*lines, "", " 　", "{broken", " " + lines[1] + "　", "null"]))
    (tmp_path / "run_1_one_entry_test.jsonl").write_text(lines[0] + "\n")
    (tmp_path / "run_2.jsonl").mkdir()
    (tmp_path / "run_2.jsonl" / "part.json").write_text(lines[3])
    found = scan_runs(spark, str(tmp_path))
    rows = [(r["ord"], r["run_id"], r["riddle_id"], r["sample_index"]) for r in found.orderBy("ord").collect()]
    assert rows == [
        (0, "run_1", "alt_0", 0), (1, "run_1", "alt_1", 1), (2, "run_1", "alt_2", None), (3, "run_1", "alt_3", 3),
        (7, "run_1", "alt_1", 1), (8, "run_1", None, None), (10, "run_2", "alt_3", 3),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    # The name of the run is worked out beside the splits, not per line.
    assert plan.count("regexp_extract") == 1 and "strategy=broadcast" in plan
