"""Column expressions on small literals."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazarlens.fixed_values import CURATED_PRODUCTS
from bazarlens.functions import context, quantiles, scalars, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_recency_is_floor_of_elapsed_time(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ'2018-08-30 15:00:00' AS ref, TIMESTAMP_NTZ'2018-08-28 16:00:00' AS last")
    assert frame.select(scalars.recency_days(F.col("ref"), F.col("last"))).first()[0] == 1


def test_category_fallback(spark):
    frame = spark.createDataFrame([("x", "X"), ("x", None), (None, None)], "pt string, en string")
    got = [r[0] for r in frame.select(scalars.category_fallback(F.col("en"), F.col("pt"))).collect()]
    assert got == ["X", "x", "unknown_category"]


def test_rate_of_nothing_is_null_and_rounding_is_half_even(spark):
    assert one(spark, scalars.pct_rate(F.lit(1), F.lit(0))) is None
    assert one(spark, scalars.round_half_even(F.lit(14.25), 1)) == 14.2
    assert one(spark, scalars.fill_zero_int(F.lit(None).cast("double"))) == 0


def test_bounds_include_both_ends(spark):
    frame = spark.createDataFrame([(-34.0,), (5.0,), (5.01,)], "lat double")
    got = [r[0] for r in frame.select(scalars.geo_valid(F.col("lat"), F.lit(-40.0))).collect()]
    assert got == [True, True, False]


def test_planar_distance(spark):
    km = one(spark, scalars.planar_km(F.lit(-23.0), F.lit(-46.0), F.lit(-23.5), F.lit(-46.6)))
    want = np.sqrt((0.5 * 111) ** 2 + (0.6 * 111 * np.cos(np.radians(-23.5))) ** 2)
    assert km == pytest.approx(want)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Não recebi, até AGORA! 3x a1bcd", "recebi agora abcd"),
        ("", ""),
        ("!!! 123", ""),
        ("um_dois três quatro\x1fcinco", "um_dois três quatro cinco"),
        ("PÉSSIMO...produto", "péssimo produto"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.lit(raw))) == clean


def test_signals_keep_stopwords_and_drop_accents(spark):
    padded = text.signal_text(F.lit("Ainda  NÃO recebi; sem nota-fiscal"))
    tokens = text.signal_tokens(F.lit("Ainda  NÃO recebi; sem nota-fiscal"))
    assert one(spark, padded) == " ainda nao recebi sem nota fiscal "
    signals = ["nao recebi", "nota fiscal", "nota", "recebi o", "ainda nao recebi sem nota"]
    assert sorted(one(spark, text.signal_matches(tokens, signals))) == ["ainda nao recebi sem nota", "nao recebi", "nota", "nota fiscal"]
    assert one(spark, text.signal_hits(text.signal_matches(tokens, signals), signals[:4])) == 3
    for nothing in ("", "  ", "notas fiscais", "recebi"):
        assert one(spark, text.signal_matches(text.signal_tokens(F.lit(nothing)), signals)) == []
    assert one(spark, text.signal_matches(text.signal_tokens(F.lit(None).cast("string")), signals)) is None


def test_signals_are_not_searched_one_by_one(spark):
    """The plan looks runs of tokens up; as whole words it finds what a search for each signal finds."""
    rng = np.random.default_rng(2)
    words = ["nao", "recebi", "nota", "fiscal", "ainda", "foto", "x"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(200)]
    signals = ["nota", "x", "nao recebi", "nota fiscal", "ainda nao recebi", "fiscal fiscal"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("tokens", text.signal_tokens(F.col("t"))).select("t", text.signal_matches(F.col("tokens"), signals).alias("m"))
    assert "ontains" not in found._jdf.queryExecution().toString()
    for row in found.collect():
        assert sorted(row["m"]) == sorted(s for s in signals if f" {s} " in f" {row['t']} ")


def test_ngrams_of_a_short_text(spark):
    tokens = F.array(F.lit("a"))
    assert one(spark, text.ngrams(tokens, 2)) == []
    assert one(spark, text.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]


def test_label_parsing(spark):
    assert one(spark, text.parse_label(F.lit("The answer: calidad_producto."))) == "Calidad_Producto"
    assert one(spark, text.parse_label(F.lit("??"))) == "Otro"
    assert one(spark, text.parse_label(F.lit("otro, or LOGISTICA_RETRASOS"))) == "Logistica_Retrasos"


def test_prompt_trims_the_comment(spark):
    prompt = one(spark, text.classify_prompt(F.lit("\n  nao chegou \t")))
    assert "(in Portuguese): nao chegou\n\nReply with ONLY" in prompt
    assert prompt.startswith("You are a classifier.") and prompt.endswith("Do not explain.")


def test_exact_percentile_interpolates(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    row = quantiles.exact_percentiles(frame, ["v"], [0.25, 0.5, 0.75, 0.8]).first()
    assert round(row["v_p80"], 6) == 5.8
    assert row["v_p50"] == 2.5 and row["v_p75"] - row["v_p25"] == 3.0


def test_percentile_of_nothing_is_null(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "v double"), ["v"], [0.5]).first()["v_p50"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.integers(min_value=0, max_value=10_000),
    st.sampled_from(["normal", "ties", "hot", "tail"]),
    st.integers(min_value=2_000, max_value=30_000),
)
def test_radix_percentile_equals_numpy(spark, seed, shape, n):
    """Also with heavy ties and values of very different sizes."""
    rng = np.random.default_rng(seed)
    values = {
        "normal": rng.normal(size=n),
        "ties": rng.integers(0, 20, n).astype(float),
        "hot": np.where(rng.random(n) < 0.34, 7.0, rng.random(n) * 100),
        "tail": rng.pareto(1.1, n) * 10.0 ** rng.integers(-200, 200, n) * rng.choice([-1, 1], n),
    }[shape]
    frame = spark.createDataFrame(pd.DataFrame({"v": values, "u": -values})).repartition(4)
    row = quantiles.exact_percentiles(frame, ["v", "u"], [0.0, 0.25, 0.5, 0.8, 1.0]).first()
    for p in (0, 25, 50, 80, 100):
        assert row[f"v_p{p}"] == pytest.approx(np.percentile(values, p), rel=1e-9, abs=0)
        assert row[f"u_p{p}"] == pytest.approx(np.percentile(-values, p), rel=1e-9, abs=0)


def test_weighted_percentiles_nulls_and_special_values(spark):
    rows = [(1.0, 3), (None, 5), (2.5, 0), (2.0, None), (-0.0, 1), (0.0, 1), (4.0, 2), (9.0, -1)]
    frame = spark.createDataFrame(rows, "v double, w int")
    row = quantiles.exact_percentiles(frame, ["v"], [0.0, 0.4, 0.5, 1.0], weight="w").first()
    plain = [0.0, 0.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert tuple(row) == pytest.approx([np.percentile(plain, p) for p in (0, 40, 50, 100)])
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -float("inf"), 5e-324, -1.0)], "v double")
    row = quantiles.exact_percentiles(odd, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    assert tuple(row)[:4] == (-float("inf"), -1.0, 5e-324, float("inf")) and math.isnan(row["v_p100"])


def test_history_sentences(spark):
    def sentence(frequency, monetary, recency):
        return one(spark, context.history_text(F.lit(frequency), F.lit(monetary), F.lit(recency), 100.0, 1000.0))

    assert sentence(2, 7388.1, 515) == "cliente recurrente (2 compras), gasto acumulado alto de R$7388, inactivo hace 515 dias."
    assert sentence(2, 151.2, 692) == "cliente recurrente (2 compras), gasto acumulado medio de R$151, inactivo hace 692 dias."
    assert sentence(1, 13440.0, 334) == "comprador de primera vez (1 compra), gasto acumulado alto de R$13440, inactivo hace 334 dias."
    status = one(spark, context.order_status_text(F.lit(515), 30))
    assert status == "Ultimo pedido hace 515 dias. Sin pedidos recientes en el sistema."


def test_json_string_escapes(spark):
    assert one(spark, context.json_string(F.lit('a "b"\nç'))) == '"a \\"b\\"\\nç"'


def test_curated_values_are_complete():
    assert [p["id"] for p in CURATED_PRODUCTS] == ["PROD-001", "PROD-002", "PROD-003"]
