"""Loading of the Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "departments", "employees", "products", "order_details",
    "tombstones", "mix_targets", "review_labels", "term_list",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily: Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Make tables available to ``spark.sql`` under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
