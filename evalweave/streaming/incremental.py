"""Incremental processing of files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evalweave.functions.parsing import strict_json
from evalweave.functions.text import strip
from evalweave.operators.ordering import first_wins
from evalweave.session import materialise
from evalweave.sources.jsonl import struct_of, typed_rows
from evalweave.sources.textlines import path_exists


def arriving_jsonl(
    spark: SparkSession,
    folder: str,
    schema: str | StructType,
    max_files: int | None = None,
) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder; blank and malformed lines drop out."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).where(strip("value") != "")
    return typed_rows(lines.withColumn("_json", strict_json(strip("value"))), schema, keep=())


#: The partition column of a target of ``append_unseen``: the hash of a row's key.
BUCKET = "key_bucket"


def _digest(keys: Sequence[str]) -> Column:
    """A digest of the key. JSON leaves NULLs out, so they equal each other and no value."""
    held = [F.coalesce(k, F.lit(1)).alias(k) if k == "sample_index" else F.col(k) for k in keys]
    return F.sha2(F.to_json(F.struct(*held)), 256)


def _bucket(digest: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def stored_keys(spark: SparkSession, target: str, keys: Sequence[str], buckets: Sequence[int]) -> DataFrame:
    """The key digests in some buckets of a target; no other bucket is read."""
    rows = spark.read.parquet(target).where(F.col(BUCKET).isin(list(buckets)))
    return rows.select(_digest(keys).alias("_digest"))


def append_unseen(
    stream: DataFrame,
    target: str,
    keys: Sequence[str],
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    order: str | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Append rows whose key is not in ``target`` yet; takes what is there and ends.

    A redelivered key is dropped, whether it comes again in the same batch, in a later one,
    or because a batch is repeated after a failure: what an earlier attempt stored is found
    by the anti join. A NULL sample index means 1, other NULLs equal each other. No streaming state is kept, so nothing grows but the target. Within a
    batch the least ``order`` of a key wins. ``transform`` runs after the anti join, so it
    only sees rows that will be stored; it keeps the key columns.

    The target is partitioned by ``key_bucket``, a hash of the key into ``buckets``, the same for
    all appends to one target. A batch reads the keys of its own buckets only, so choose so many that
    a batch of arrivals meets few of them; one file is written per bucket that a batch meets.
    """

    def process(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_digest", _digest(keys))
        fresh = first_wins(rows, ["_digest"], order) if order else rows.dropDuplicates(["_digest"])
        if path_exists(spark, target):
            met = rows.select(_bucket("_digest", buckets).alias("b")).distinct().collect()
            seen = stored_keys(spark, target, keys, sorted(r["b"] for r in met))
            fresh = fresh.join(seen, "_digest", "left_anti")
        fresh = fresh.drop("_digest")
        if transform is not None:
            fresh = transform(fresh)
        placed = fresh.withColumn(BUCKET, _bucket(_digest(keys), buckets)).repartition(BUCKET)
        placed.write.mode("append").partitionBy(BUCKET).parquet(target)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def handled_rows(
    rows: DataFrame,
    handle: Callable[[Row], dict],
    schema: str | StructType,
    max_concurrency: int = 10,
) -> DataFrame:
    """The rows with ``out``, what ``handle`` returns for them, or ``error``, what it raised.

    A row that fails touches no other row; a result that lacks a field of ``schema`` has NULL there.
    At most ``max_concurrency`` calls run at once in a task.
    """
    kind = struct_of(schema)
    whole = StructType(list(rows.schema.fields)).add("out", kind).add("error", "string")

    def call(row: dict) -> tuple:
        try:
            got = handle(Row(**row))
            return {f.name: got.get(f.name) for f in kind.fields}, None
        except Exception as exc:  # the failure is a value of the row
            return None, f"{type(exc).__name__}: {exc}"

    fields = list(to_arrow_schema(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_concurrency) as pool:
            for batch in batches:
                got = list(pool.map(call, batch.to_pylist()))
                more = [pa.array([g[i] for g in got], fields[i - 2].type) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema(
                    [*batch.schema, *[pa.field(f.name, f.type) for f in fields[-2:]]]
                ))

    return rows.mapInArrow(run, whole)


def append_handled(
    stream: DataFrame,
    target: str,
    failed: str,
    checkpoint: str,
    handle: Callable[[Row], dict],
    schema: str | StructType,
    max_concurrency: int = 10,
) -> StreamingQuery:
    """Call ``handle`` for every arriving row; results go to ``target``, failures to ``failed``.

    A row whose call raises is stored in ``failed`` as it came, with ``error``, in the same
    micro-batch, and the stream goes on. Each call's result is stored once before it is
    dealt out, so no row is handled twice in an attempt. Both tables hold a partition per batch, which a
    repeated batch replaces: good and failed rows always add up to what arrived.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        done = materialise(handled_rows(batch, handle, schema, max_concurrency), "handled")
        good = done.where("error IS NULL").select("out.*")
        good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        done.where("error IS NOT NULL").drop("out").write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_arrivals(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Store every arriving row as soon as its file is read; each file exactly once."""
    rows = transform(stream) if transform is not None else stream
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keyed_once(stream: DataFrame, keys: Sequence[str], delay: str | None = None, time: str | None = None) -> DataFrame:
    """Drop repeated keys in streaming state.

    Without ``delay`` the state keeps every key for good. With an event-time column ``time``
    and a ``delay``, keys older than the watermark are forgotten.
    """
    if delay and time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))
