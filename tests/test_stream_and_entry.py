import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as E
from equipledger.operators import ledger as L
from equipledger.sources.commits import CommitConflict, commit, latest_commit
from equipledger.sources.state import change, read_state, start, write_delta
from equipledger.sources.tables import read_ledger
from equipledger.streaming import movements as T
from tests.conftest import SF_SMALL, rows
from tests.fixtures import frame


def test_stream_equals_batch_and_replay_is_idempotent(spark, scratch):
    T0 = dt.datetime(2024, 1, 1)
    events = [{"event_id": f"e{i:03d}", "event_time": T0 + dt.timedelta(hours=i), "kind": k,
               "warehouse_id": "W1", "siz_item_id": "I1", "size_value": "", "employee_id": "U1", "quantity": q}
              for i, (k, q) in enumerate([("receipt", 5), ("issue", 3), ("issue", 3), ("receipt", 2), ("issue", 4),
                                          ("issue", 1)])]
    stock = frame(spark, "warehouse_stock", [{"id": "s", "warehouse_id": "W1", "siz_item_id": "I1",
                                              "size_value": "", "quantity": 1}])
    holdings = frame(spark, "employee_siz", [])
    items = frame(spark, "siz_items", [{"id": "I1"}])
    inbox, state = os.path.join(scratch, "inbox"), os.path.join(scratch, "state")
    for part, chunk in enumerate((events[:3], events[3:])):
        frame(spark, "movement_events", chunk).coalesce(1).write.parquet(f"{inbox}/part={part}")
    T.seed_state(stock, holdings, state)
    q = T.stream_movements(spark, f"{inbox}/part=*", state, items, files_per_batch=1)
    q.awaitTermination(180)
    streamed = rows(T.final_stock(spark, state), "warehouse_id", "quantity")
    batch = L.apply_movements(stock, holdings, frame(spark, "movement_events", events), items)
    # 1 + 5 - 3 - 3 + 2 = 2; the issue of 4 is rejected; - 1 leaves 1.
    assert streamed == rows(batch.stock, "warehouse_id", "quantity") == [("W1", 1)]
    assert len(rows(read_ledger(spark, state, "stock_movements"), "id")) == 5
    # Replaying a committed batch changes nothing; the versions before stay readable.
    before = latest_commit(spark, state)
    T.apply_batch(spark, frame(spark, "movement_events", events[3:]), 1, state, items)
    assert latest_commit(spark, state) == before and before[0] == 2
    assert [rows(T.final_stock(spark, state, v), "quantity") for v in range(3)] == [[(1,)], [(0,)], [(1,)]]
    assert len(rows(read_ledger(spark, state, "stock_movements"), "id")) == 5


def test_an_id_delivered_twice_counts_once(spark, scratch):
    T0 = dt.datetime(2024, 1, 1)
    ev = lambda e, k, q, h=0: {"event_id": e, "event_time": T0 + dt.timedelta(hours=h), "kind": k, "warehouse_id": "W1",
                               "siz_item_id": "I1", "employee_id": "U1", "quantity": q}
    state, items = os.path.join(scratch, "state"), frame(spark, "siz_items", [{"id": "I1"}])
    T.seed_state(frame(spark, "warehouse_stock", []), frame(spark, "employee_siz", []), state)
    T.apply_batch(spark, frame(spark, "movement_events", [ev("a", "receipt", 5), ev("a", "receipt", 5), ev("b", "receipt", 1, 1),
                                                          ev("b", "receipt", 9, 2), ev(None, "receipt", 1), ev(None, "receipt", 1)]), 0, state, items)
    assert rows(T.final_stock(spark, state), "quantity") == [(8,)]
    back = {"event_id": "r", "event_time": T0 + dt.timedelta(hours=9), "kind": "return", "warehouse_id": "W2", "holding_id": "c", "quantity": 2}
    T.apply_batch(spark, frame(spark, "movement_events", [ev("a", "receipt", 7, 5), ev("c", "issue", 6, 6), ev("c", "issue", 6, 6)]), 1, state, items)
    T.apply_batch(spark, frame(spark, "movement_events", [back, dict(back, quantity=4, event_time=T0 + dt.timedelta(hours=10))]), 2, state, items)
    assert rows(T.final_stock(spark, state), "warehouse_id", "quantity") == [("W1", 2), ("W2", 2)]
    held = read_state(spark, state, "employee_siz").first()
    assert (held.id, held.quantity, held.status) == ("c", 4, "active")
    again = spark.read.parquet(f"{state}/repeats")
    assert sorted((r.batch, r.event_id, r.rows) for r in again.collect()) == [(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "c", 1), (2, "r", 1)]


def test_a_batch_writes_its_changes_not_the_state(spark, scratch):
    state, items = os.path.join(scratch, "state"), frame(spark, "siz_items", [{"id": "I1"}])
    stock = frame(spark, "warehouse_stock", [{"id": str(i), "warehouse_id": f"W{i}", "siz_item_id": "I1", "size_value": "", "quantity": 9}
                                             for i in range(500)])
    T.seed_state(stock, frame(spark, "employee_siz", []), state)
    want = {f"W{i}": 9 for i in range(500)}
    for b in range(4):
        move = [{"event_id": f"{b}-{i}", "event_time": dt.datetime(2024, 1, 1 + b), "kind": k, "warehouse_id": f"W{i}", "siz_item_id": "I1",
                 "employee_id": "U1", "quantity": q} for i, k, q in ((b, "issue", 4), (7, "receipt", 1), (400 + b, "drop", None), (401, "issue", 99))]
        T.apply_batch(spark, frame(spark, "movement_events", move), b, state, items, compact_after=3)
        want[f"W{b}"] -= 4
        want["W7"] += 1
        want.pop(f"W{400 + b}", None)
        parts = latest_commit(spark, state)[1]["tables"]["warehouse_stock"]
        if b == 0:
            assert spark.read.parquet(f"{state}/{parts['deltas'][0]}").count() == 3
        assert len(parts["deltas"]) == (1, 2, 0, 1)[b]      # the third is folded into a new base
        assert {r.warehouse_id: r.quantity for r in T.final_stock(spark, state).collect()} == want
    some = read_state(spark, state, "warehouse_stock", stock.where("warehouse_id in ('W7', 'W402', 'W450')"))
    assert rows(some, "warehouse_id", "quantity") == [("W450", 9), ("W7", 13)]


def test_commits_are_won_by_one_writer(spark, scratch):
    start(spark, scratch, {"seen_events": frame(spark, "seen_events", [{"id": "a", "batch": 0}])})
    one = frame(spark, "seen_events", [{"id": "b", "batch": 1}])
    write_delta(one, scratch, "seen_events")                      # a crash before the commit
    assert rows(read_state(spark, scratch, "seen_events"), "id") == [("a",)]
    assert change(spark, scratch, 0, {"seen_events": one}) == 1
    with pytest.raises(CommitConflict):                           # made from the same version
        change(spark, scratch, 0, {"seen_events": frame(spark, "seen_events", [{"id": "c", "batch": 1}])})
    assert rows(read_state(spark, scratch, "seen_events"), "id") == [("a",), ("b",)]
    with pytest.raises(CommitConflict):
        commit(spark, scratch, 1, {})
    commit(spark, scratch, 2, {"tables": {}})
    with open(f"{scratch}/_commits/{3:012d}.json", "w") as f:
        f.write('{"tab')
    with pytest.raises(ValueError):
        latest_commit(spark, scratch)


def test_events_of_an_actor_without_the_right_are_refused(spark):
    from equipledger.operators import scope as S
    users = frame(spark, "users", [{"id": "a", "role_id": "admin_ia", "is_active": True},
                                   {"id": "e", "role_id": "admin_enterprise", "is_active": True}])
    ev = frame(spark, "movement_events", [{"event_id": str(i), "kind": k, "actor_id": a} for i, (k, a) in enumerate(
        [("receipt", "a"), ("receipt", "e"), ("set", "a"), ("bogus", "a"), ("issue", None)])])
    ok, refused = T.admitted(ev, S.actor_context(users, S.seed_roles(spark)))
    assert rows(ok, "event_id") == [("0",), ("2",)]
    assert rows(refused, "event_id", "reason") == [("1", "permission"), ("3", "unknown_operation"), ("4", "no_actor")]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 29 and df.count() > 0


ORACLE_SUBSET = ["card_stats", "card_stats_by_enterprise", "entitlement_counts", "positions_report",
                 "stock_totals", "latest_audit", "warehouse_staff_counts", "admit_requests", "ledger_decisions",
                 "import_stock_summary", "norms_upsert", "patch_employees_audit", "import_items_rows",
                 "latest_movements", "cards_search", "norms_insert_absent", "transactions_report", "adjust_stock",
                 "movement_page", "patch_series", "patch_series_audit", "adjust_series", "adjust_series_audit",
                 "norms_insert_first", "ledger_repeats_decisions", "ledger_hot_decisions", "ledger_kinds_decisions", "ledger_kinds_stock",
                 "ledger_kinds_holdings", "admit_all_operations", "cards_of_res_actor", "transactions_of_res_actor",
                 "org_tree_of_res_actor", "org_tree_nodes", "users_report", "equipment_cards", "norm_report", "entitlements", "movement_report"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_oracle_pairs_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=key)
    o = sorted((tuple(_norm(r[ocols.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert s == o


def test_every_query_has_an_oracle():
    """The training-data queries have none (the README says why); every other query has its SQL."""
    from equipledger.plans import catalog
    assert set(catalog.REGISTRY) <= set(E.oracle_sql())


def test_mixed_events_reach_every_kind_and_refusal(spark):
    from equipledger.plans import catalog as C
    ev = C.tables(spark, SF_SMALL).mixed_movement_events().select("event_id", "kind")
    got = C.ledger_kinds_decisions(spark, SF_SMALL).join(ev, "event_id").select("kind", "reason").distinct().collect()
    assert {r["kind"] for r in got if r["reason"] is None} == {"receipt", "transfer", "issue", "return", "set", "drop"}
    assert {r["reason"] for r in got} >= {"invalid", "insufficient_stock", "no_holding", "no_stock_row"}
