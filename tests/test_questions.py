"""The questions end to end, from a folder of CSV files."""

import pytest
from pyspark.sql import functions as F

from bazarlens.plans import questions
from bazarlens.schemas import CSV_FILES
from bazarlens.sources import proxies, tables



@pytest.fixture(scope="module")
def shop(spark, sf_dir, tmp_path_factory):
    """The proxy tables written as the CSV files of the data set and read back."""
    folder = str(tmp_path_factory.mktemp("csv"))
    source = proxies.marketplace(spark, sf_dir)
    for name, (file, _) in CSV_FILES.items():
        tables.write_csv(getattr(source, name), f"{folder}/{file}")
    return tables.load_csv_tables(spark, folder)


def test_best_sellers(spark, shop, sf_dir):
    by_units, by_revenue = questions.best_sellers(shop, 3)
    want_units, want_revenue = questions.best_sellers(proxies.marketplace(spark, sf_dir), 3)
    assert by_units.collect() == want_units.collect()
    assert [r[0] for r in by_revenue.collect()] == [r[0] for r in want_revenue.collect()]


def test_complaint_report(shop):
    report = questions.complaint_report(shop, min_reviews=5)
    assert sum(r["pct"] for r in report.distribution.collect()) == pytest.approx(100)
    rates = [r["tasa_insatisfaccion"] for r in report.rates.collect()]
    assert rates and all(0 <= rate <= 100 for rate in rates)
    assert all(r["posicion"] <= 5 for r in report.per_pain.collect())
    assert report.top_terms.filter("n = 1").count() > 0
    report.multi_pain.collect()
    assert report.delivery_share.first()["pct_combined"] is not None


def test_location(shop):
    report = questions.store_location(shop)
    center, cover = report.centroid.first(), report.coverage.first()
    assert -34 <= center["lat_opt"] <= 5 and -74 <= center["lng_opt"] <= -34
    assert cover["km_median"] <= cover["km_p80"]
    matches = report.matches.first()
    assert matches["n_orders"] >= matches["n_matched"] >= matches["n_valid"] == cover["n_orders"]
    assert report.cities.count() == 10 and report.national.count() > 10


def test_knowledge_base_and_prompts(spark, shop):
    segmented = spark.createDataFrame(
        [("3", 10, 2, 50.0, "Cliente_Fiel_Activo"), ("4", 9, 1, 5.0, None)],
        "customer_unique_id string, recency long, frequency long, monetary double, segmento string",
    )
    document = questions.knowledge_base(shop).first()
    assert document["total_productos"] == 0 and document["version"] == "1.0"
    products = spark.createDataFrame(
        [("P1", "c", "n", "d", 1.5, (1.0, 2.0), 3, True, ["t"])],
        "id string, categoria string, nombre string, descripcion string, precio_promedio_real double, "
        "rango_precios struct<minimo: double, maximo: double>, unidades_vendidas long, destacado boolean, tags array<string>",
    )
    classified = questions.complaints.classify_by_signals(questions.reviews.filter_bad_reviews(shop.reviews))
    prompts = questions.agent_prompts(shop, segmented, classified, products)
    assert prompts.count() == 2
    assert prompts.filter(F.col("system_prompt").isNull()).count() == 0


def test_segments_partition_the_customers(shop):
    segmented = questions.customer_segments(shop, restarts=2).cache()
    base = questions.rfm.rfm(shop.orders, shop.items, shop.customers)
    assert segmented.count() == base.count() == segmented.select("customer_unique_id").distinct().count()
    names = {r[0] for r in segmented.filter("frequency = 1").select("segmento").distinct().collect()}
    assert names <= {"Alto_Valor_Durmiente", "Esporadico_Comun", None}
