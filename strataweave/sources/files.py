"""Reading and writing tables in the common file formats, and scripts of statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table from files. Give a schema for CSV and JSON: inferring one reads the data twice."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    reader = spark.read.options(**({"header": "true"} if form == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(form).load(path)


def write(
    df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), codec: str | None = None
) -> None:
    """A table to files. ``sort_by`` orders rows within files, which makes Parquet statistics selective; ``codec`` is the compression."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.format(form).mode(mode)
    if form == "csv":
        writer = writer.option("header", "true")
    if codec:
        writer = writer.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by a key: joins and groupings on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, in ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def statements(script: str) -> list[str]:
    """Statements of a script, split at semicolons outside quotes, comments and BEGIN ... END blocks."""
    out, part, i, depth = [], [], 0, 0
    word = ""
    while i < len(script):
        c = script[i]
        if script.startswith("--", i):
            end = script.find("\n", i)
            i = len(script) if end < 0 else end
            continue
        if script.startswith("/*", i):
            end = script.find("*/", i)
            i = len(script) if end < 0 else end + 2
            continue
        if c in "'\"`":
            end = i + 1
            while end < len(script) and (script[end] != c or script[end + 1 : end + 2] == c):
                end += 2 if script[end] == c else 1
            part.append(script[i : end + 1])
            i, word = end + 1, ""
            continue
        if c.isalnum() or c == "_":
            word += c
        else:
            if word.upper() == "BEGIN" and "".join(part).strip().upper() != "BEGIN":
                depth += 1
            elif word.upper() == "END" and depth:
                depth -= 1
            word = ""
        if c == ";" and not depth:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
        i += 1
    out.append("".join(part).strip())
    return [s for s in out if s]
