"""New reviews are classified once, as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bazarlens.operators.complaints import classify_by_signals
from bazarlens.operators.reviews import filter_bad_reviews
from bazarlens.streaming.events import run_append


def read_reviews(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def classify_stream(
    reviews: DataFrame, target: str, checkpoint: str, classifier: Callable[[DataFrame], DataFrame] = classify_by_signals
) -> DataFrame:
    """Classify the bad reviews among the new rows and append them.

    The checkpoint remembers which files were read, so a second run on the
    same files adds nothing and a lost run goes on where it stopped.
    """
    return run_append(classifier(filter_bad_reviews(reviews)), target, checkpoint)
