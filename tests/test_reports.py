import datetime as dt

from pyspark.sql import functions as F

from equipledger.operators import nested as N
from equipledger.operators import reports as R
from tests.conftest import plan_text, rows
from tests.fixtures import frame, org


def test_warehouse_staff_rules(spark):
    """The five J9 rules, first match wins; the warehouse may be inactive."""
    t = org(spark)
    staff = R.warehouse_staff(t["warehouses"], t)
    got = {}
    for r in staff.collect():
        got.setdefault(r.warehouse_id, set()).add(r.employee_id)
    # Enterprise E1 set (rule 4) -> E1 employees without res unit (U2; U4 inactive).
    # Spbipk set (rule 2) but no enterprise of its own -> '= NULL' -> nobody.
    # Res unit R1 (rule 1) -> U1.   W4: ia without enterprise (rule 3) -> U3.
    # Nothing set (rule 5) -> every active employee.
    assert got == {"W1": {"U2"}, "W3": {"U1"}, "W4": {"U3"}, "W5": {"U1", "U2", "U3"}}
    counts = dict(rows(R.warehouse_staff_counts(t["warehouses"], t["employees"]), "warehouse_id", "staff_count"))
    assert counts == {"W1": 1, "W2": 0, "W3": 1, "W4": 1, "W5": 3}
    assert "NestedLoop" not in plan_text(staff) and "Cartesian" not in plan_text(staff)


def test_count_children_zero_when_none(spark):
    t = org(spark)
    got = dict(rows(R.categories_report(t["siz_categories"], t["siz_items"]), "id", "items_count"))
    assert got == {"C1": 2, "C2": 0}   # I3 is inactive


def test_items_search_and_labels(spark):
    t = org(spark)
    got = rows(R.items_report(t["siz_items"], t["siz_categories"], text="каск"), "id", "category_name")
    assert got == [("I1", "Helmets")]


def test_latest_movements_matches_brute_force(spark):
    moves = []
    base = dt.datetime(2024, 1, 1)
    for i in range(300):
        frm = f"W{i % 3}" if i % 4 else None
        to = f"W{(i + 1) % 3}" if i % 5 else None
        moves.append({"id": f"m{i:03d}", "from_warehouse_id": frm, "to_warehouse_id": to,
                      "created_at": base + dt.timedelta(days=i // 7), "movement_type": "transfer"})
    df = frame(spark, "stock_movements", moves)
    top = R.latest_movements(df, n=20)
    assert "WindowGroupLimit" in plan_text(top)      # map-side top-k before the shuffle
    got = {(r.warehouse_id, r.rank): r.id for r in top.collect()}
    want = {}
    for w in ("W0", "W1", "W2"):
        mine = [m for m in moves if w in (m["from_warehouse_id"], m["to_warehouse_id"])]
        mine.sort(key=lambda m: (m["created_at"], m["id"]), reverse=True)
        for k, m in enumerate(mine[:20], 1):
            want[(w, k)] = m["id"]
    assert got == want


def test_audit_report_is_top_k(spark):
    audit = frame(spark, "audit_log", [{"id": f"a{i}", "table_name": "t" if i % 2 else "u",
                                         "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)}
                                        for i in range(50)])
    users = frame(spark, "users", [])
    df = R.audit_report(audit, users, table_name="t", n=5)
    assert [r.id for r in df.orderBy(F.col("created_at").desc()).collect()] == ["a49", "a47", "a45", "a43", "a41"]
    assert "TakeOrderedAndProject" in plan_text(df)


def test_reports_have_no_nested_loops(spark):
    from equipledger.plans import catalog
    for name in ("equipment_cards", "entitlements", "stock_report", "holdings_report", "movement_report",
                 "norm_report", "warehouse_staff_counts", "latest_movements"):
        p = plan_text(catalog.REGISTRY[name](spark, "/root/testdata/sf0.001"))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_org_tree_nested_and_flat(spark):
    t = org(spark)
    tree = N.org_tree(t).collect()
    assert len(tree) == 1
    o = tree[0]
    assert [w.id for w in o.warehouses] == ["W4"]
    ents = {e.id: e for e in o.enterprises}
    assert set(ents) == {"E1", "E2"}
    assert ents["E2"].spbipk_list == [] and ents["E2"].res_units == []
    sp = ents["E1"].spbipk_list[0]
    assert sp.id == "S1" and [w.id for w in sp.warehouses] == ["W2"]
    ru = ents["E1"].res_units[0]
    assert [w.id for w in ru.warehouses] == ["W3"] and [d.id for d in ru.departments] == ["D1"]
    nodes = rows(N.org_tree_nodes(t), "node_type", "node_id")
    # W1 hangs directly off an enterprise: the tree has no list for such warehouses.
    assert ("warehouse", "W4") in nodes and ("department", "D1") in nodes and len(nodes) == 9
    assert ("warehouse", "W1") not in nodes


def test_org_tree_scoped_res_actor(spark):
    t = org(spark)
    tree = N.org_tree(t, {"role_level": "res", "enterprise_id": "E1", "res_unit_id": "R1"}).first()
    assert [e.id for e in tree.enterprises] == ["E1"]


def test_employee_cards_norms(spark):
    t = org(spark)
    t["position_siz_norms"] = frame(spark, "position_siz_norms", [
        {"id": "n1", "position_id": "P1", "siz_item_id": "I1", "quantity": 2, "is_active": True},
        {"id": "n2", "position_id": "P1", "siz_item_id": "I3", "quantity": 1, "is_active": True},
        {"id": "n3", "position_id": "P1", "siz_item_id": "I2", "quantity": 1, "is_active": False}])
    cards = {r.id: r for r in N.employee_cards(t).collect()}
    assert len(cards) == 4                                  # inactive employees too
    assert sorted(n.siz_item_id for n in cards["U1"].norms) == ["I1", "I3"]   # item activity not required
    ent = dict(rows(R.entitlement_counts(t["employees"], t["position_siz_norms"], t["siz_items"]),
                    "employee_id", "items"))
    assert ent["U1"] == 1                                   # entitlements require an active item


def test_movements_without_a_user_are_not_joined_for_one(spark):
    t = dict(org(spark))
    t["users"] = frame(spark, "users", [{"id": "U", "full_name": "User"}])
    moves = frame(spark, "stock_movements", [{"id": "a", "siz_item_id": "I1", "moved_by": "U"}, {"id": "b", "siz_item_id": "I1", "moved_by": None},
                                             {"id": "c", "siz_item_id": "I1", "moved_by": "?"}, {"id": None, "siz_item_id": "I1", "moved_by": None}])
    got = R.movement_report(t, moves)
    assert sorted((str(r.id), r.moved_by_name) for r in got.collect()) == [("None", None), ("a", "User"), ("b", None), ("c", None)]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    nobody = R.movement_report(t, moves.withColumn("moved_by", F.lit(None).cast("string")))
    assert joins(nobody) == joins(R.movement_report(t, moves)) - 1
