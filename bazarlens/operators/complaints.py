"""Complaint texts: lexical signals, classification, resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazarlens.fixed_values import RESIDUAL_LABEL, SIGNALS_PT, TAXONOMY
from bazarlens.functions.text import (
    classify_prompt,
    clean_text,
    parse_label,
    signal_hits,
    signal_matches,
    signal_tokens,
    truncate_text,
)
from bazarlens.operators.profiling import top_k

CLASSIFIED_COLUMNS = ["review_id", "order_id", "review_score", "review_comment_message", "pain_point_category"]


def cleaned_corpus(corpus: DataFrame, text: str = "review_comment_message") -> DataFrame:
    return corpus.withColumn("texto_limpio", clean_text(F.col(text)))


def longest_texts(cleaned: DataFrame, k: int = 3) -> DataFrame:
    """The k longest cleaned texts with the first 120 characters of both forms."""
    sized = cleaned.withColumn("n_chars", F.length("texto_limpio").cast("long"))
    longest = top_k(sized, [F.desc("n_chars"), F.asc("review_id")], k)
    return longest.select(
        "review_id",
        "n_chars",
        truncate_text(F.col("review_comment_message"), 120).alias("original"),
        truncate_text(F.col("texto_limpio"), 120).alias("limpio"),
    )


def signal_match(corpus: DataFrame, signals: dict[str, list[str]] = SIGNALS_PT) -> DataFrame:
    """One column per label with the number of its signals in the text.

    The text is cut into tokens once, for all labels together.
    """
    found = signal_matches(F.col("fichas"), [s for words in signals.values() for s in words])
    matched = corpus.withColumn("fichas", signal_tokens(F.col("review_comment_message"))).withColumn("senales", found)
    return matched.select(*corpus.columns, *[signal_hits(F.col("senales"), words).alias(label) for label, words in signals.items()])


def signal_rows(matched: DataFrame, signals: dict[str, list[str]] = SIGNALS_PT) -> DataFrame:
    """(review_id, categoria, n_senales), labels without a hit left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("categoria"), F.col(c).alias("n_senales")) for c in signals])
    return matched.select("review_id", F.inline(pairs)).filter(F.col("n_senales") > 0)


def signal_stats(corpus: DataFrame, signals: dict[str, list[str]] = SIGNALS_PT) -> DataFrame:
    """Signals of each label by number of words, and the texts they occur in.

    One row per signal that a text holds goes into partial counts;
    ``n_textos`` adds the counts of a label's signals up.
    """
    entries = [(label, signal) for label, words in signals.items() for signal in words]
    found = signal_matches(F.col("fichas"), [signal for _, signal in entries])
    hits = corpus.select(signal_tokens(F.col("review_comment_message")).alias("fichas")).select(F.explode(found).alias("senal")).groupBy("senal").agg(F.count(F.lit(1)).alias("n"))
    rows = corpus.sparkSession.createDataFrame(entries, "categoria string, senal string").join(hits, "senal", "left")
    words = F.size(F.split("senal", " "))
    kind = F.when(words == 1, "unigrama").when(words == 2, "bigrama").otherwise("trigrama")
    return (
        rows.groupBy("categoria", kind.alias("tipo"))
        .agg(F.count(F.lit(1)).alias("n_senales"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_textos"))
    )


def classify_by_signals(corpus: DataFrame, signals: dict[str, list[str]] = SIGNALS_PT) -> DataFrame:
    """Default classifier: first label of the taxonomy with a lexical signal.

    One JVM projection. It stands in for the language model, which is an
    external service; no equality with a model's answers is claimed.
    """
    matched = signal_match(corpus, signals)
    choice = F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in TAXONOMY if c in signals], F.lit(RESIDUAL_LABEL))
    return matched.withColumn("pain_point_category", choice).select(CLASSIFIED_COLUMNS)


def classify_with(corpus: DataFrame, answer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Classify with a caller-given model: prompts in, raw answers out.

    ``answer`` gets Arrow batches of rendered prompts inside the tasks; labels
    are read from its answers by the same rule as before, in the JVM.
    """
    prompts = corpus.withColumn("prompt", classify_prompt(F.col("review_comment_message")))
    schema = T.StructType(prompts.schema.fields[:-1] + [T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="prompt").assign(answer=answer(batch["prompt"]))

    answered = prompts.mapInPandas(run, schema)
    return answered.withColumn("pain_point_category", parse_label(F.trim("answer"))).select(CLASSIFIED_COLUMNS)


def anti_done(corpus: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose review was not classified before."""
    return corpus.join(done.select("review_id"), "review_id", "left_anti")


def union_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def classify_resume(
    corpus: DataFrame,
    results_path: str,
    classifier: Callable[[DataFrame], DataFrame] = classify_by_signals,
    slices: int = 1,
) -> DataFrame:
    """Classify what is pending and append it; returns the results so far.

    With ``slices`` > 1 the pending rows are appended in that many parts, by
    hash of the review, so a run that is lost repeats at most one part.
    """
    spark = corpus.sparkSession
    for part in range(slices):
        try:
            done = spark.read.parquet(results_path)
            pending = anti_done(corpus, done)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            pending = corpus
        if slices > 1:
            pending = pending.filter(F.pmod(F.xxhash64("review_id"), F.lit(slices)) == part)
        classifier(pending).write.mode("append").parquet(results_path)
    return spark.read.parquet(results_path)
