import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from equipledger.operators import ledger as L

from tests.conftest import plan_text, rows
from tests.fixtures import D, frame


def replay(stock, holdings, events):
    """Brute force: one global dict walk over all events in (event_time, event_id) order."""
    bal, exists, hold, hold_item = {}, set(), {}, {}
    for s in stock:
        k = (s["warehouse_id"], s["siz_item_id"], s.get("size_value") or "")
        bal[k] = bal.get(k, 0) + s["quantity"]
        exists.add(k)
    for h in holdings:
        hold[h["id"]] = h["quantity"] if h["status"] == "active" else 0
        hold_item[h["id"]] = (h["siz_item_id"], h.get("size_value") or "")
    out = {}
    for e in sorted(events, key=lambda e: (e["event_time"], e["event_id"])):
        kind, q, size = e["kind"], e.get("quantity"), e.get("size_value") or ""
        req = {"receipt": ["warehouse_id", "siz_item_id"], "transfer": ["warehouse_id", "to_warehouse_id", "siz_item_id"],
               "issue": ["warehouse_id", "employee_id", "siz_item_id"], "return": ["warehouse_id", "holding_id"],
               "set": ["warehouse_id", "siz_item_id"], "drop": ["warehouse_id", "siz_item_id"]}[kind]
        lo = {"set": 0, "drop": None}.get(kind, 1)
        if any(e.get(c) is None for c in req) or (lo is not None and (q is None or q < lo)):
            out[e["event_id"]] = (False, "invalid")
            continue
        src = (e["warehouse_id"], e.get("siz_item_id"), size)
        if kind == "receipt":
            bal[src] = bal.get(src, 0) + q
            exists.add(src)
            ok = True
        elif kind in ("transfer", "issue"):
            ok = bal.get(src, 0) >= q
            if ok:
                bal[src] -= q
                if kind == "transfer":
                    dst = (e["to_warehouse_id"], e["siz_item_id"], size)
                    bal[dst] = bal.get(dst, 0) + q
                    exists.add(dst)
                else:
                    hold[e["event_id"]] = q
                    hold_item[e["event_id"]] = (e["siz_item_id"], size)
        elif kind == "return":
            h = e["holding_id"]
            if h not in hold_item:
                out[e["event_id"]] = (False, "no_holding")
                continue
            ok = hold.get(h, 0) >= q
            if ok:
                hold[h] -= q
                k = (e["warehouse_id"],) + hold_item[h]
                bal[k] = bal.get(k, 0) + q
                exists.add(k)
        else:
            ok = src in exists
            if ok:
                bal[src] = q if kind == "set" else 0
                if kind == "drop":
                    exists.discard(src)
        out[e["event_id"]] = (ok, None)
    final = {k: v for k, v in bal.items() if k in exists}
    return out, final


def random_case(seed, n=120, with_links=True):
    rnd = random.Random(seed)
    whs, items = ["W1", "W2", "W3"], ["I1", "I2"]
    stock = [{"warehouse_id": w, "siz_item_id": i, "size_value": "", "quantity": rnd.randint(0, 6)}
             for w in whs for i in items if rnd.random() < 0.6]
    holdings = [{"id": "H0", "employee_id": "U1", "siz_item_id": "I1", "size_value": "", "quantity": 3,
                 "status": "active"}]
    kinds = ["receipt", "issue", "issue", "transfer", "return", "set", "drop"] if with_links else ["receipt", "issue"]
    events, issued = [], ["H0"]
    t0 = dt.datetime(2024, 1, 1)
    for j in range(n):
        k = rnd.choice(kinds)
        e = {"event_id": f"e{j:04d}", "event_time": t0 + dt.timedelta(hours=rnd.randint(0, 72)), "kind": k,
             "warehouse_id": rnd.choice(whs), "siz_item_id": rnd.choice(items), "size_value": "",
             "quantity": rnd.randint(1, 4)}
        if k == "transfer":
            e["to_warehouse_id"] = rnd.choice(whs)   # may equal the source
        if k == "issue":
            e["employee_id"] = "U1"
            issued.append(e["event_id"])
        if k == "return":
            e["holding_id"] = rnd.choice(issued + ["nope"])
            e["siz_item_id"] = None
        if k == "set":
            e["quantity"] = rnd.randint(0, 5)
        if k == "drop":
            e["quantity"] = None
        if rnd.random() < 0.03:
            e["quantity"] = 0   # statically invalid for movements
        events.append(e)
    return stock, holdings, events


def frames(spark, stock, holdings, events):
    st = frame(spark, "warehouse_stock", [dict(s, id=f"{s['warehouse_id']}/{s['siz_item_id']}") for s in stock])
    ho = frame(spark, "employee_siz", holdings)
    ev = frame(spark, "movement_events", events)
    return st, ho, ev


@pytest.mark.parametrize("seed,links", [(1, True), (2, True), (3, True), (4, False), (5, False)])
def test_decisions_match_replay(spark, seed, links):
    stock, holdings, events = random_case(seed, with_links=links)
    want, final = replay(stock, holdings, events)
    st, ho, ev = frames(spark, stock, holdings, events)
    got = {r.event_id: (r.accepted, r.reason) for r in L.decide(st, ho, ev).collect()}
    assert set(got) == set(want)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    items = frame(spark, "siz_items", [{"id": "I1", "exploitation_years": decimal.Decimal("1.00")}, {"id": "I2"}])
    res = L.apply_movements(st, ho, ev, items)
    new = {(r.warehouse_id, r.siz_item_id, r.size_value): r.quantity for r in res.stock.collect()}
    assert new == final
    # The same stock derived independently from the accepted events.
    acc = L._decide(st, ho, ev, L.WRITTEN).judged.where("accepted")
    again = {(r.warehouse_id, r.siz_item_id, r.size_value): r.quantity for r in L.new_stock(st, acc).collect()}
    assert again == final


@pytest.mark.parametrize("seed,links", [(41, True), (42, True), (44, False)])
def test_hot_units_match_replay(spark, seed, links):
    """Units cut at hours: sure hours taken whole, the others replayed; decisions and available as in the plain fold."""
    stock, holdings, events = random_case(seed, n=300, with_links=links)
    for e in events:      # enough stock that some hours are sure after a first refusal
        if e["kind"] == "receipt":
            e["quantity"] = 5
    want, final = replay(stock, holdings, events)
    st, ho, ev = frames(spark, stock, holdings, events)
    hot = L.decide(st, ho, ev, hot_events=3).collect()
    plain = L.decide(st, ho, ev, hot_events=10**9).collect()
    assert sorted(map(str, hot)) == sorted(map(str, plain))
    assert {r.event_id: r.accepted for r in hot} == {k: v[0] for k, v in want.items()}
    d = L._decide(st, ho, ev, hot_events=3)
    got = {(r.key, r.siz_item_id, r.size_value): r.balance for r in d.finals.where("exists").collect()}
    assert all(final[k] == v for k, v in got.items())


def test_sure_hours_of_a_hot_unit_are_not_replayed(spark):
    """One refused issue in the first of 50 hours: only that hour is replayed event by event."""
    events = [{"event_id": f"e{h:02d}{i}", "event_time": dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=i),
               "kind": "receipt" if i % 2 else "issue", "warehouse_id": "W1", "siz_item_id": "I1", "employee_id": "U1",
               "quantity": 4 if i % 2 else 3} for h in range(50) for i in range(6)]
    st, ho, ev = frames(spark, [], [], events)
    parts = L._decide(st, ho, ev, hot_events=10).slow.groupBy("rec").count().collect()
    assert {r["rec"]: r["count"] for r in parts} == {"d": 6, "e": 49, "s": 1}
    assert sum(not r.accepted for r in L.decide(st, ho, ev, hot_events=10).collect()) == 1


def test_rows_of_one_id_are_judged_one_by_one(spark):
    T = lambda h: dt.datetime(2024, 1, 1, h)
    base = {"warehouse_id": "W1", "siz_item_id": "I1", "employee_id": "U1"}
    events = [{**base, "event_id": e, "event_time": T(h), "kind": k, "quantity": q} for e, h, k, q in (
        ("a", 1, "issue", 9), ("b", 2, "receipt", 5), ("x", 3, "issue", 3), ("x", 4, "issue", 2))]
    st, ho, ev = frames(spark, [], [], events)
    items = frame(spark, "siz_items", [{"id": "I1"}])
    for hot in (1, 10**6):
        assert sorted((r.event_id, r.accepted, r.available) for r in L.decide(st, ho, ev, hot).collect()) == [
            ("a", False, 0), ("b", True, None), ("x", True, 2), ("x", True, 5)]
    res = L.apply_movements(st, ho, ev, items)
    assert res.decisions.count() == 4 and res.movements.count() == 3
    assert rows(res.stock, "warehouse_id", "quantity") == [("W1", 0)]
    same = frame(spark, "movement_events", [dict(e, event_time=T(3)) for e in events[1:]] + [dict(events[2], event_time=T(3))])
    got = sorted((r.event_id, r.accepted) for r in L.decide(st, ho, same).collect())
    assert len(got) == 4 and sum(a for _, a in got) == 3


def test_fast_tier_only_when_clean(spark):
    """A batch that never overdraws is decided without any Python fold input rows and all accepted."""
    stock = [{"warehouse_id": "W1", "siz_item_id": "I1", "size_value": "", "quantity": 10}]
    events = [{"event_id": f"e{i}", "event_time": dt.datetime(2024, 1, 1, i), "kind": "issue", "warehouse_id": "W1",
               "siz_item_id": "I1", "employee_id": "U1", "quantity": 2} for i in range(5)]
    st, ho, ev = frames(spark, stock, [], events)
    d = L.decide(st, ho, ev)
    assert all(r.accepted for r in d.collect())
    assert [r.available for r in d.orderBy("event_id").collect()] == [10, 8, 6, 4, 2]


def test_partial_then_full_return_and_transfer_to_self(spark):
    stock = [{"warehouse_id": "W1", "siz_item_id": "I1", "size_value": "M", "quantity": 5}]
    T = lambda h: dt.datetime(2024, 1, 1, h)
    events = [
        {"event_id": "a", "event_time": T(1), "kind": "issue", "warehouse_id": "W1", "siz_item_id": "I1",
         "size_value": "M", "employee_id": "U1", "quantity": 4},
        {"event_id": "b", "event_time": T(2), "kind": "return", "warehouse_id": "W2", "holding_id": "a", "quantity": 1},
        {"event_id": "c", "event_time": T(3), "kind": "return", "warehouse_id": "W2", "holding_id": "a", "quantity": 3},
        {"event_id": "d", "event_time": T(4), "kind": "return", "warehouse_id": "W2", "holding_id": "a", "quantity": 1},
        {"event_id": "e", "event_time": T(5), "kind": "transfer", "warehouse_id": "W1", "to_warehouse_id": "W1",
         "siz_item_id": "I1", "size_value": "M", "quantity": 1},
    ]
    st, ho, ev = frames(spark, stock, [], events)
    items = frame(spark, "siz_items", [{"id": "I1", "exploitation_years": None}])
    res = L.apply_movements(st, ho, ev, items)
    dec = {r.event_id: r.accepted for r in res.decisions.collect()}
    assert dec == {"a": True, "b": True, "c": True, "d": False, "e": True}
    h = res.holdings.where("id = 'a'").first()
    # Closed by the return of 3: status 'returned', the stored quantity is that of the closing return.
    assert (h.status, h.quantity, h.returned_date, h.exploitation_start) == ("returned", 3, D("2024-01-01"), None)
    st2 = {r.warehouse_id: r.quantity for r in res.stock.collect()}
    assert st2 == {"W1": 1, "W2": 4}
    mv = {r.id: (r.movement_type, r.from_warehouse_id, r.to_warehouse_id, r.employee_id) for r in res.movements.collect()}
    assert mv["b"] == ("return", None, "W2", "U1") and mv["e"] == ("transfer", "W1", "W1", None)


def test_reset_between_two_issues(spark):
    stock = [{"warehouse_id": "W1", "siz_item_id": "I1", "size_value": "", "quantity": 2}]
    T = lambda h: dt.datetime(2024, 1, 1, h)
    events = [
        {"event_id": "a", "event_time": T(1), "kind": "issue", "warehouse_id": "W1", "siz_item_id": "I1",
         "employee_id": "U1", "quantity": 2},
        {"event_id": "b", "event_time": T(2), "kind": "set", "warehouse_id": "W1", "siz_item_id": "I1", "quantity": 7},
        {"event_id": "c", "event_time": T(3), "kind": "issue", "warehouse_id": "W1", "siz_item_id": "I1",
         "employee_id": "U1", "quantity": 5},
        {"event_id": "d", "event_time": T(4), "kind": "set", "warehouse_id": "W9", "siz_item_id": "I1", "quantity": 1},
    ]
    st, ho, ev = frames(spark, stock, [], events)
    items = frame(spark, "siz_items", [{"id": "I1"}])
    res = L.apply_movements(st, ho, ev, items)
    dec = {r.event_id: (r.accepted, r.available) for r in res.decisions.collect()}
    assert dec == {"a": (True, 2), "b": (True, 0), "c": (True, 7), "d": (False, 0)}
    assert rows(res.stock, "warehouse_id", "quantity") == [("W1", 2)]
    aud = {r.action: r.changes for r in res.audit.collect() if r.table_name == "warehouse_stock"}
    assert '"old_quantity":0' in aud["update"] and '"new_quantity":7' in aud["update"]


def test_two_halves_equal_one_batch(spark):
    stock, holdings, events = random_case(11, with_links=False)
    st, ho, ev = frames(spark, stock, holdings, events)
    items = frame(spark, "siz_items", [{"id": "I1"}, {"id": "I2"}])
    once = L.apply_movements(st, ho, ev, items)
    events = sorted(events, key=lambda e: (e["event_time"], e["event_id"]))
    first, second = events[:60], events[60:]
    r1 = L.apply_movements(st, ho, frame(spark, "movement_events", first), items)
    r2 = L.apply_movements(r1.stock, r1.holdings, frame(spark, "movement_events", second), items)
    key = ("warehouse_id", "siz_item_id", "size_value", "quantity")
    assert rows(once.stock, *key) == rows(r2.stock, *key)


def test_import_stock_rules(spark):
    items = frame(spark, "siz_items", [{"id": "I1", "is_active": True}, {"id": "I2", "is_active": False}])
    payload = frame(spark, "import_stock", [
        {"siz_item_id": "I1", "size_value": " 42\t", "quantity": "3"},
        {"siz_item_id": "I1", "size_value": "42", "quantity": "2 pcs"},
        {"siz_item_id": "I1", "size_value": "43", "quantity": "0"},
        {"siz_item_id": "", "size_value": "43", "quantity": "5"},
        {"siz_item_id": "I1", "size_value": None, "quantity": "abc"},
        {"siz_item_id": "I2", "size_value": "1", "quantity": "1"},
        {"siz_item_id": "I9", "size_value": "1", "quantity": "1"}])
    out = L.import_stock(payload, items, "W1", today="2024-03-05")
    assert rows(out["deltas"], "siz_item_id", "size_value", "quantity") == [("I1", "42", 5)]
    assert dict(rows(out["summary"], "outcome", "rows")) == {"imported": 2, "skipped": 3, "error": 2}
    mv = out["movements"].collect()
    assert len(mv) == 2 and {m.document_reference for m in mv} == {"Импорт остатков 05.03.2024"}
    assert len({m.id for m in mv}) == 2


def test_retire_warehouses(spark):
    wh = frame(spark, "warehouses", [{"id": w, "is_active": True} for w in ("W1", "W2", "W3")])
    stock = frame(spark, "warehouse_stock", [
        {"warehouse_id": "W1", "siz_item_id": "I1", "quantity": 3},
        {"warehouse_id": "W2", "siz_item_id": "I1", "quantity": 2},
        {"warehouse_id": "W2", "siz_item_id": "I2", "quantity": -2}])
    req = spark.createDataFrame([("W1",), ("W2",), ("W3",), ("W9",)], "id string")
    out = L.retire_warehouses(wh, stock, req)
    assert rows(out["warehouses"], "id", "is_active") == [("W1", True), ("W2", False), ("W3", False)]
    assert rows(out["refused"], "id", "total") == [("W1", 3)]
    assert rows(out["missing"], "id") == [("W9",)]


@pytest.mark.parametrize("seed", [21, 22])
def test_quantity_is_conserved(spark, seed):
    """Without resets nothing is created or destroyed except by receipts: stock + active holdings after the
    batch = opening stock + opening active holdings + accepted receipts."""
    stock, holdings, events = random_case(seed)
    events = [e for e in events if e["kind"] not in ("set", "drop")]
    st, ho, ev = frames(spark, stock, holdings, events)
    items = frame(spark, "siz_items", [{"id": "I1"}, {"id": "I2"}])
    res = L.apply_movements(st, ho, ev, items)
    acc = {r.event_id for r in res.decisions.collect() if r.accepted}
    receipts = sum(e["quantity"] for e in events if e["kind"] == "receipt" and e["event_id"] in acc)
    before = sum(s["quantity"] for s in stock) + sum(h["quantity"] for h in holdings if h["status"] == "active")
    after = sum(r.quantity for r in res.stock.collect()) + \
        sum(r.quantity for r in res.holdings.collect() if r.status == "active")
    assert after == before + receipts


def test_fast_tier_has_no_python(spark):
    stock, holdings, events = random_case(31)
    st, ho, ev = frames(spark, stock, holdings, events)
    tiers = L._decide(st, ho, ev)
    fast_plan = plan_text(tiers.fast)
    assert "Python" not in fast_plan and "ArrowEval" not in fast_plan and "InPandas" not in fast_plan
    slow_plan = plan_text(tiers.slow)
    assert "MapInPandas" in slow_plan and "CoGroups" not in slow_plan


def test_import_into_an_inactive_warehouse_is_refused(spark):
    items = frame(spark, "siz_items", [{"id": "I1", "is_active": True}])
    wh = frame(spark, "warehouses", [{"id": "W1", "is_active": True}, {"id": "W2", "is_active": False}])
    payload = frame(spark, "import_stock", [{"siz_item_id": "I1", "size_value": "\u00a042", "quantity": "\u00a03"},
                                            {"siz_item_id": "I1", "size_value": "1", "quantity": "99999999999"}])
    ok = L.import_stock(payload, items, "W1", today="2024-03-05", warehouses=wh, batch="b1")
    assert rows(ok["deltas"], "size_value", "quantity") == [("42", 3)]
    assert '"count":1,"skipped":0,"errors":1' in ok["audit"].first().changes
    again = L.import_stock(payload, items, "W1", today="2024-03-05", warehouses=wh, batch="b2")
    assert rows(ok["movements"], "id") != rows(again["movements"], "id")
    no = L.import_stock(payload, items, "W2", today="2024-03-05", warehouses=wh)
    assert rows(no["summary"], "outcome", "rows") == [("no_warehouse", 2)]
    assert rows(no["deltas"]) == [] and rows(no["audit"]) == []


def test_fold_is_shipped_by_value():
    """Python workers need not import this package: the ledger module (with the fold) is pickled by value."""
    import pickle

    from pyspark import cloudpickle
    blob = cloudpickle.dumps(L._fold)
    assert pickle.loads(blob) is not None
    assert "equipledger.operators.ledger" in cloudpickle.cloudpickle.list_registry_pickle_by_value()


def test_balances_take_one_shuffle_of_the_legs(spark):
    """Legs, their openings, running balances, cuts and last legs: one exchange beside the sum of the openings; written as Parquet."""
    st, ho, ev = frames(spark, *random_case(7, with_links=False))
    kept = L.legs(ev.withColumns({"tie": F.lit(0), "pos": F.monotonically_increasing_id()}), keep=("tie", "pos", *L.JUDGED))
    cold = L._cold_balances(kept.withColumn("chunk", F.lit(0).cast("long")), L._openings(st, ho, None))
    plan = cold._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    fast = plan_text(L._decide(st, ho, ev).fast)
    assert "parquet" in fast and "ExistingRDD" not in fast


def test_hot_and_cold_items_of_one_batch(spark):
    """An item with many events beside one with few: decisions, available and final stock as without hot items."""
    stock, holdings, events = random_case(51, n=200, with_links=True)
    calm = [dict(e, event_id=f"c{i}", siz_item_id="I9") for i, e in enumerate(events) if e["kind"] in ("receipt", "issue")][:5]
    st, ho, ev = frames(spark, stock, holdings, events + calm)
    items = frame(spark, "siz_items", [{"id": "I1"}])
    both, plain = L._decide(st, ho, ev, hot_events=8), L._decide(st, ho, ev, hot_events=10**9)
    for part in ("judged", "finals"):
        got, want = (sorted(map(str, getattr(d, part).where("exists" if part == "finals" else "true").collect())) for d in (both, plain))
        assert got == want
    want, final = replay(stock, holdings, events + calm)
    judged = {r.event_id: r.accepted for r in both.judged.collect()}
    assert judged == {k: want[k][0] for k in judged}
    assert {(r.warehouse_id, r.siz_item_id, r.size_value): r.quantity for r in L.apply_movements(st, ho, ev, items).stock.collect()} == final


def test_an_event_without_a_time_counts_first(spark):
    base = {"warehouse_id": "W1", "siz_item_id": "I1", "employee_id": "U1"}
    st, ho, ev = frames(spark, [], [], [{**base, "event_id": "n", "kind": "receipt", "quantity": 5},
                                        {**base, "event_id": "a", "event_time": dt.datetime(2024, 1, 1), "kind": "issue", "quantity": 3}])
    for hot in (1, 10**6):
        assert [(r.event_id, r.accepted, r.available) for r in L.decide(st, ho, ev, hot).collect()] == [("a", True, 5)]
