"""What a micro-batch leaves on disk: its ledgers, decisions and changes, nothing that it wrote for itself."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from equipledger.schemas import conform, empty
from equipledger.session import checkpoint_dir, intermediates_dropped, materialized, shared_dir
from equipledger.sources.tables import read_ledger
from equipledger.streaming import movements as T

EVENT = "event_id string, event_time timestamp, kind string, warehouse_id string, siz_item_id string, size_value string, employee_id string, quantity int"
DAYS = [dt.datetime(2024, 1, 5), dt.datetime(2024, 2, 6), dt.datetime(2024, 2, 7)]


def batch(spark):
    rows = [(f"e{k}", DAYS[k % 3], T.RECEIPT if k % 2 else T.ISSUE, "w", "A", "", "u", 2) for k in range(12)] + [("e1", DAYS[2], T.RECEIPT, "w", "A", "", "u", 9)]
    items = conform(spark.createDataFrame([("A",)], "id string"), "siz_items")
    stock = spark.createDataFrame([("s", "w", "A", "", 50)], "id string, warehouse_id string, siz_item_id string, size_value string, quantity int")
    return conform(stock, "warehouse_stock"), items, conform(spark.createDataFrame(rows, EVENT), "movement_events")


def test_a_batch_leaves_no_intermediates(spark, scratch):
    stock, items, events = batch(spark)
    T.seed_state(stock, empty(spark, "employee_siz"), f"{scratch}/state")
    checkpoint_dir(spark)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    T.apply_batch(spark, events, 0, f"{scratch}/state", items)
    assert set(os.listdir(folder)) == before
    moves, audit = (read_ledger(spark, f"{scratch}/state", x) for x in ("stock_movements", "audit_log"))
    assert {r.id for r in moves.collect()} == {f"e{k}" for k in range(12)} and moves.where("month = date_format(created_at, 'yyyy-MM')").count() == 12
    assert {(r.record_id, r.month) for r in audit.collect()} == {(f"e{k}", DAYS[k % 3].strftime("%Y-%m")) for k in range(12)}
    assert T.final_stock(spark, f"{scratch}/state").first().quantity == 50
    names = [f for _, _, files in os.walk(f"{scratch}/state") for f in files if f.endswith(".parquet")]
    assert names and all(".zstd." in f for f in names)


def test_a_failed_step_drops_its_files_too(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with pytest.raises(ZeroDivisionError):
        with intermediates_dropped(spark):
            assert materialized(spark.range(5), "x").agg(F.sum("id")).first()[0] == 10
            1 / 0
    assert set(os.listdir(folder)) == before
    materialized(spark.range(5), "kept")
    assert len(set(os.listdir(folder)) - before) == 1
