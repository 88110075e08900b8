"""Intermediate tables in the folder that all executors share.

Lineage is cut with a written table, never with a local checkpoint: the files
survive the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # executors on other machines
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strataweave-")
    return _OWN[app]


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back.

    The files are deleted at the end of the enclosing :func:`intermediates`, by
    :func:`discard`, or when the JVM ends. Row order within a file is kept,
    the split into partitions is not: write the partition number as a column
    where it matters.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataweave_path = path
    for made in _OPEN:
        made.append(out)
    return out


@contextmanager
def intermediates() -> Iterator[None]:
    """Tables written inside are deleted at the end: compute or save the results before."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_strataweave_path", None)
    if path:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
