"""Lenient JSONL scans and JSONL sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from evalweave.functions.parsing import json_truthy, let, strict_json
from evalweave.functions.text import NOT_SPACE, strip
from evalweave.sources.textlines import numbered_lines, path_exists


def struct_of(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _typed(row: Column, field: StructField) -> Column:
    """One field of a line's ``_raw_fields``; a value of another type does not cost the row.

    A flag follows the truth of the JSON value; a NULL or absent one stays NULL.
    """
    value = row.getField(field.name)
    if isinstance(field.dataType, BooleanType):
        return let(F.to_json(value), lambda r: F.when(r.isNotNull() & (r != "null"), json_truthy(r)))
    return value


def _raw_fields(schema: StructType) -> str:
    """The type that a line is read as in one go; flags are left as JSON values."""
    kinds = [(f.name, "variant" if isinstance(f.dataType, BooleanType) else f.dataType.simpleString()) for f in schema]
    return f"struct<{','.join(f'`{name}`:{kind}' for name, kind in kinds)}>"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Add ``_json``; blank lines drop out, malformed ones have NULL there."""
    value = F.col("value")
    # A line from brace to brace has nothing to strip, and looking for it costs as much as parsing.
    text = F.when(value.startswith("{") & value.endswith("}"), value).otherwise(strip(value))
    return lines.where(value.rlike(NOT_SPACE)).withColumn("_json", strict_json(text))


def typed_rows(parsed: DataFrame, schema: str | StructType, keep: tuple = ("ord",)) -> DataFrame:
    schema = struct_of(schema)
    fields = [_typed(F.col("_row"), f).alias(f.name) for f in schema]
    # A filter on the parsed value would move below its projection and parse every line twice.
    read = parsed.select(*keep, F.explode(F.array_compact(F.array("_json"))).alias("_json"))
    row = F.try_variant_get("_json", "$", _raw_fields(schema)).alias("_row")
    return read.select(*keep, row).select(*keep, *fields)


def scan_jsonl(
    spark: SparkSession, path: str, schema: str | StructType
) -> DataFrame:
    """Rows of a JSONL file or folder with ``ord``; malformed lines are skipped.

    A missing path raises.
    """
    return typed_rows(parsed_lines(numbered_lines(spark, path)), schema)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, ord, value) of the lines that ``scan_jsonl`` skips as malformed."""
    parsed = parsed_lines(numbered_lines(spark, path))
    return parsed.where(F.col("_json").isNull()).select("path", "line_no", "ord", "value")


def scan_jsonl_if_exists(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """As ``scan_jsonl``, empty with the same columns when the path is missing."""
    if path_exists(spark, path):
        return scan_jsonl(spark, path, schema)
    fields = StructType().add("ord", "long")
    for field in struct_of(schema).fields:
        fields = fields.add(field)
    return spark.createDataFrame([], fields)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; every partition adds its own file."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a JSONL folder, also when ``df`` reads from it.

    The rows are written beside the target first and take its place when they are complete.
    The old folder is moved aside and deleted last, so a failed job leaves it in place.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, aside = f"{path.rstrip('/')}.__new__{mark}", f"{path.rstrip('/')}.__old__{mark}"
    df.write.option("ignoreNullFields", "false").json(fresh)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, source, old = path_of(path), path_of(fresh), path_of(aside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"could not move {fresh} to {path}")
    if held:
        fs.delete(old, True)
