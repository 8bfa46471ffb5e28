"""Readers for the marketplace tables (CSV or parquet) and plain table sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazarlens import schemas
from bazarlens.fixed_values import CSV_MISSING
from bazarlens.sources.csv_split import read_split_csv


@dataclass(frozen=True)
class Marketplace:
    """The star schema, one lazy frame per table."""

    orders: DataFrame
    items: DataFrame
    products: DataFrame
    translation: DataFrame
    reviews: DataFrame
    customers: DataFrame
    geolocation: DataFrame


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted text that may hold commas, quotes and line ends.

    Columns are taken by header name, so a file may hold more columns than
    ``schema`` names; a byte-order mark is dropped. A file is read by many
    tasks, see :mod:`bazarlens.sources.csv_split`; its lines are written once
    for that. Where the quotes of a file do not pair up, Spark's multi-line
    reader decides, one task a file. ``multi_line=False`` is for files without
    a line end inside quotes and needs no such pass.
    """
    raw = read_split_csv(spark, path) if multi_line else None
    if raw is None:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    if schema is None:
        return raw
    columns = []
    for field in T.StructType.fromDDL(schema):
        present = F.when(~F.col(field.name).isin(CSV_MISSING), F.col(field.name))
        columns.append(present.cast(field.dataType).alias(field.name))
    return raw.select(columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV in the dialect that :func:`read_csv` reads."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet result table."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_csv_tables(spark: SparkSession, folder: str) -> Marketplace:
    """The whole star schema from a folder of CSV files."""
    frames = {
        name: read_csv(spark, f"{folder}/{file}", schema, multi_line=(name == "reviews"))
        for name, (file, schema) in schemas.CSV_FILES.items()
    }
    return Marketplace(**frames)


def load_profile_only(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that are shown but never queried: payments and sellers."""
    return {
        name: read_csv(spark, f"{folder}/{file}", multi_line=False)
        for name, file in schemas.PROFILE_ONLY_FILES.items()
    }


def load_parquet_tables(spark: SparkSession, folder: str) -> Marketplace:
    """The star schema from parquet folders named like the tables."""
    return Marketplace(
        **{name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, (_, schema) in schemas.CSV_FILES.items()}
    )
