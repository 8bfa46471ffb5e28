"""Nested JSON documents and published result versions."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlens import schemas


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("errorifexists").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge base document as one row per product."""
    document = spark.read.schema(schemas.KNOWLEDGE_BASE).option("multiLine", True).json(path)
    return document.select("version", F.explode("productos").alias("producto")).select("version", "producto.*")


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Publish ``df`` as the current version under ``base``.

    The rows go to a folder of their own; only after they are complete is the
    pointer with the next number made, by a create that fails if the file is
    there. A reader follows the largest number whose version is complete, so
    it sees the old version or the new one, never a mixture, also when a job
    is lost. A writer that died before, at whatever point, blocks nobody: its
    number is passed over. Of two writers of one number the second takes the
    next one, so the last to finish is the current version.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{base}/versions/{folder}")
    number = max((n for n, _ in _entries(spark, base)), default=0) + 1
    while not _create(spark, f"{base}/current/{number}", folder):
        number += 1
    return folder


def file_system(spark: SparkSession, path: str):
    """(file system, path) on the driver's JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content, unless something of that name exists."""
    files, target = file_system(spark, path)
    try:
        stream = files.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(target):
            return False
        raise
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def _entries(spark: SparkSession, base: str) -> list[tuple[int, str | None]]:
    """(number, path of the pointer) from the largest number on; the path is missing where no pointer can be read."""
    files, folder = file_system(spark, f"{base}/current")
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        number = re.search(r"(\d+)$", status.getPath().getName())
        if number and not status.getPath().getName().startswith((".", "_")):
            found.append((int(number[1]), status.getPath().toString() if status.isFile() and status.getLen() else None))
    return sorted(found, key=lambda e: (-e[0], e[1] is None))


def read_published(spark: SparkSession, base: str) -> DataFrame:
    """The complete version with the largest number; entries of writers that died are passed over."""
    for _, pointer in _entries(spark, base):
        row = spark.read.text(pointer).first() if pointer else None
        if row:
            files, done = file_system(spark, f"{base}/versions/{row[0]}/_SUCCESS")
            if files.exists(done):
                return spark.read.parquet(f"{base}/versions/{row[0]}")
    raise FileNotFoundError(f"nothing is published under {base}")
