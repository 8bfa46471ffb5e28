"""Small frames for the text operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    """Documents with ids from ``start`` on; a pair is (id, text)."""
    rows = [x if isinstance(x, tuple) else (start + i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def clashing(frame):
    """The same rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("score", "kept", "node", "component", "id", "member", "centre", "bucket", "n_shingles", "held_out", "part", "key", "place", "hash", "t", "m", "u", "ids"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit("x"))
    return frame
