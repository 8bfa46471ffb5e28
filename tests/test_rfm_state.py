import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazarlens.operators import rfm, rfm_state
from bazarlens.session import fresh_path


def made_shop(spark, n=600):
    rng = np.random.default_rng(4)
    days = pd.Timestamp("2018-01-01") + pd.to_timedelta(rng.integers(0, 300 * 24, n), unit="h")
    # One customer has a third of all orders; some orders are not delivered, some have no items.
    account = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 90, n))
    status = rng.choice(["delivered", "delivered", "delivered", "shipped"], n)
    orders = spark.createDataFrame(pd.DataFrame({"order_id": np.arange(n), "customer_id": account, "order_status": status, "order_purchase_timestamp": days}))
    orders = orders.withColumn("order_purchase_timestamp", F.col("order_purchase_timestamp").cast("timestamp_ntz"))
    items = spark.createDataFrame(pd.DataFrame({"order_id": rng.integers(0, n, 2 * n), "product_id": 1, "price": rng.random(2 * n) * 90, "freight_value": 0.0}))
    # Two accounts may be one person; one account has no person.
    customers = pd.DataFrame({"customer_id": np.arange(90), "customer_unique_id": [None if i == 13 else f"u{i // 2}" for i in range(90)], "customer_city": "c", "customer_state": "s", "customer_zip_code_prefix": 1})
    return orders, items, spark.createDataFrame(customers)


def rows(frame):
    return {r["customer_unique_id"]: (r["recency"], r["frequency"], pytest.approx(r["monetary"])) for r in frame.collect()}


def test_three_batches_equal_a_recompute(spark):
    orders, items, customers = made_shop(spark)
    base = fresh_path(spark, "rfm-state")
    with pytest.raises(FileNotFoundError):
        rfm_state.customer_sums(spark, base)
    # By month, so that the reference date moves on with each batch.
    month = F.month("order_purchase_timestamp")
    parts = [orders.where(month <= 5), orders.where(month.between(6, 8)), orders.where(month > 8)]
    seen = None
    for batch, part in enumerate(parts, 1):
        rfm_state.add_orders(base, batch, part, items, customers)
        seen = part if seen is None else seen.unionByName(part)
        now = rfm_state.as_rfm(rfm_state.customer_sums(spark, base), rfm_state.latest_reference(spark, base))
        whole = rows(rfm.rfm(seen, items, customers))
        assert rows(now) == whole
        changed = rows(rfm_state.as_rfm(rfm_state.changed_sums(spark, base, batch), rfm_state.latest_reference(spark, base)))
        touched = set(rows(rfm.rfm(part, items, customers)))
        assert changed == {u: r for u, r in whole.items() if u in touched} and len(changed) < len(whole) or batch == 1
        if batch == 2:
            assert rfm_state.fold(spark, base) == 2
    assert rfm_state._parts(spark, base) == [f"{base}/folded/upto=2", f"{base}/deltas/batch=3"]


def test_lost_and_repeated_runs(spark):
    """What a lost run left does not count; a batch given again changes nothing."""
    orders, items, customers = made_shop(spark, 200)
    base = fresh_path(spark, "rfm-state")
    first, second = orders.where("order_id % 2 = 0"), orders.where("order_id % 2 = 1")
    rfm_state.add_orders(base, 1, first, items, customers)
    before = rows(rfm_state.as_rfm(rfm_state.customer_sums(spark, base), rfm_state.latest_reference(spark, base)))
    # A run that died while it wrote its delta, and one that died while it folded.
    rfm_state.add_orders(base, 2, second, items, customers)
    rfm_state.fold(spark, base)
    os.remove(f"{base}/deltas/batch=2/_SUCCESS")
    os.remove(f"{base}/folded/upto=2/_SUCCESS")
    assert rows(rfm_state.as_rfm(rfm_state.customer_sums(spark, base), rfm_state.latest_reference(spark, base))) == before
    for _ in range(2):
        rfm_state.add_orders(base, 2, second, items, customers)
    after = rows(rfm_state.as_rfm(rfm_state.customer_sums(spark, base), rfm_state.latest_reference(spark, base)))
    assert after == rows(rfm.rfm(orders, items, customers))
    rfm_state.fold(spark, base)
    assert rows(rfm_state.as_rfm(rfm_state.customer_sums(spark, base), rfm_state.latest_reference(spark, base))) == after


def test_plan_reads_the_new_orders_only(spark):
    orders, items, customers = made_shop(spark, 100)
    base, source = fresh_path(spark, "rfm-state"), fresh_path(spark, "orders")
    rfm_state.add_orders(base, 1, orders, items, customers)
    orders.where("order_id < 5").write.parquet(source)
    rfm_state.add_orders(base, 2, spark.read.parquet(source), items, customers)
    files = rfm_state.changed_sums(spark, base, 2).inputFiles()
    assert files and all(f"{base}/deltas/" in f for f in files)
