"""Reading text files line by line with a position for every line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def numbered_lines(spark: SparkSession, path: str, **of_path: Column) -> DataFrame:
    """(value, ord, line_no, path): every line of the files, files in path order.

    ``of_path`` are further columns made from ``path``; they are worked out once per split, not per line.

    No sort and no single task is involved. Within a file split the generated row ids rise
    in line order, so a line's number is its id minus the split's first id plus the number
    of lines in earlier splits, known from one aggregate over (file, split). That aggregate has
    one short row per split and is broadcast, so the lines are not shuffled.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = raw.groupBy("path", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    # One row per split: lines in earlier files, and in earlier splits of the same file.
    files = splits.groupBy("path").agg(F.sum("_lines").alias("_file_lines"))
    before_file = _running(files, [], "path", "_file_lines", "_before")
    before_split = _running(splits, ["path"], "_start", "_lines", "_inside")
    offsets = before_split.join(before_file.select("path", "_before"), "path").select(
        "path", "_start", "_first", "_before", "_inside"
    )
    # Made by a generator: a filter on a plain projection would move down to every line.
    for name, made in of_path.items():
        offsets = offsets.select("*", F.explode(F.array(made)).alias(name))
    line = F.col("_inside") + F.col("_id") - F.col("_first")
    return raw.join(F.broadcast(offsets), ["path", "_start"]).select(
        "value",
        (F.col("_before") + line).alias("ord"),
        (line + 1).alias("line_no"),
        "path",
        *of_path,
    )


def stem(extension: str) -> Column:
    """Name of the file, or of the folder that holds the parts, without the extension."""
    # Tried at the start of each part of the path only; otherwise its cost is quadratic in the path.
    return F.regexp_extract("path", rf"(?<![^/=])([^/=]+)\.{extension}(?:/[^/]*)?$", 1)


def _running(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    window = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))
