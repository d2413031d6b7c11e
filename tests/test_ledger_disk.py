"""What the ledger writes and shuffles: no copy of the legs, no holdings that nobody returns, lineitem read once."""

import datetime as dt
import os

from pyspark.sql import functions as F

from equipledger.operators import ledger as L
from equipledger.schemas import conform, empty
from equipledger.session import shared_dir
from equipledger.sources.mapping import MappedTables

T0 = dt.datetime(2024, 1, 1)
EVENT = ("event_id string, event_time timestamp, kind string, warehouse_id string, to_warehouse_id string, siz_item_id string, "
         "size_value string, employee_id string, holding_id string, quantity int")


def batch(spark):
    """Ten issues of item A, of which two are returned in part; the last return asks for more than is held."""
    rows = [(f"i{k}", T0 + dt.timedelta(hours=k), L.ISSUE, "w", None, "A", "", "e", None, 2) for k in range(10)]
    rows += [(f"r{k}", T0 + dt.timedelta(days=1, hours=k), L.RETURN, "w", None, None, None, None, f"i{k % 2}", 1) for k in range(5)]
    rows += [("lost", T0, L.RETURN, "w", None, None, None, None, "nowhere", 1)]
    stock = spark.createDataFrame([("s", "w", "A", "", 18)], "id string, warehouse_id string, siz_item_id string, size_value string, quantity int")
    return conform(stock, "warehouse_stock"), empty(spark, "employee_siz"), conform(spark.createDataFrame(rows, EVENT), "movement_events")


def test_only_returned_holdings_have_balances(spark):
    stock, holdings, events = batch(spark)
    ev, _, resolved = L.prepare_events(events, holdings)
    lg = L.legs(ev, keep=("tie", "pos", *L.JUDGED)).where(F.col("key").isNotNull())
    lg = lg.withColumn("chunk", F.expr("unix_seconds(event_time) div 3600"))
    lb = L._cold_balances(lg, L._openings(stock, holdings, lg if resolved else None))
    assert {r.key for r in lb.where(F.col("key_type") == L.HOLDING).collect()} == {"i0", "i1"}
    assert lb.where(F.col("key_type") == L.STOCK).count() == 15


def test_decisions_of_returns_and_what_is_written(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    got = {r.event_id: (r.accepted, r.reason, r.available) for r in L.decide(*batch(spark)).collect()}
    assert len(got) == 16
    assert [got[f"i{k}"][0] for k in range(10)] == [True] * 9 + [False] and got["i9"] == (False, "insufficient_stock", 0)
    assert [got[f"r{k}"] for k in range(5)] == [(True, None, 2), (True, None, 2), (True, None, 1), (True, None, 1), (False, "insufficient_holding", 0)]
    assert got["lost"] == (False, "no_holding", None)
    names = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before}
    assert "ledger-returns" in names and "ledger-legs" not in names


def test_mixed_events_read_lineitem_once(spark):
    ev = MappedTables(spark, "/root/testdata/sf0.001").mixed_movement_events()
    plan = ev._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x and "l_linenumber" in x for x in plan) == 1


def test_judged_events_take_one_shuffle_and_no_file(spark):
    """Balances and decisions are made where the one shuffle by item put the events: none is written or joined to its event."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    judged = L._decide(*batch(spark), L.WRITTEN).judged
    assert judged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert judged.count() == 15
    names = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not names & {"ledger-balances", "ledger-fold", "ledger-judged"}


def test_events_are_written_without_their_hash(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    L._decide(*batch(spark))
    for name in set(os.listdir(folder)) - before:
        assert "tie" not in spark.read.parquet(f"{shared_dir(spark)}/{name}").columns, name


def test_holdings_read_the_judged_events_once(spark):
    stock, holdings, events = batch(spark)
    items = conform(spark.createDataFrame([("A",)], "id string"), "siz_items")
    res = L.apply_movements(stock, holdings, events, items, materialize=False)
    assert res.holdings._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    got = {r.id: (r.quantity, r.status) for r in res.holdings.collect()}
    assert len(got) == 9 and got["i0"] == (1, "returned")
    assert got["i1"] == (1, "returned") and got["i8"] == (2, "active")
