
from pyspark.sql import functions as F

from equipledger.operators import changes as M
from equipledger.operators import checks as K
from equipledger.operators import imports as I
from equipledger.operators import scope as S
from equipledger.sources.imports import EmptyPayload, read_import
from tests.conftest import rows
from tests.fixtures import frame, org


def test_row_scope_rules(spark):
    t = org(spark)
    e = t["employees"]
    assert len(rows(S.row_scope(e, "employees", {"role_level": "ia"}), "id")) == 4
    assert rows(S.row_scope(e, "employees", {"role_level": "res", "res_unit_id": "R1"}), "id") == [("U1",)]
    # A NULL scope id compares as '= NULL': no rows.
    assert rows(S.row_scope(e, "employees", {"role_level": "enterprise", "enterprise_id": None}), "id") == []
    # departments: only res actors are scoped.
    assert len(rows(S.row_scope(t["departments"], "departments", {"role_level": "spbipk"}), "id")) == 1


def test_admission(spark):
    users = frame(spark, "users", [{"id": "a", "role_id": "admin_ia", "is_active": True},
                                   {"id": "e", "role_id": "admin_enterprise", "is_active": True},
                                   {"id": "r", "role_id": "admin_res", "is_active": True},
                                   {"id": "x", "role_id": "admin_ia", "is_active": False}])
    actors = S.actor_context(users, S.seed_roles(spark))
    req = spark.createDataFrame([("1", "a", "stock.adjust"), ("2", "e", "receipt"), ("3", "r", "norms.upsert"),
                                 ("4", "r", "receipt"), ("5", "x", "receipt"), ("6", "a", "bogus")],
                                "request_id string, actor_id string, operation string")
    got = dict(rows(S.admit_requests(req, actors), "request_id", "refusal"))
    assert got == {"1": None, "2": "permission", "3": "level", "4": None, "5": "no_actor", "6": "unknown_operation"}


def test_patch_rows_sets_null_and_merges_extra(spark):
    cur = frame(spark, "employees", [
        {"id": "U1", "last_name": "A", "first_name": "B", "extra": '{"a":1,"b":2}', "is_active": True},
        {"id": "U2", "last_name": "C", "extra": "{}", "is_active": True}])
    patches = spark.createDataFrame(
        [("U1", 1, ["first_name", "last_name"], "A", None, '{"b":3,"c":4}', "admin"),
         ("U2", 2, [], None, None, None, "admin"),
         ("U9", 3, ["last_name"], "Z", None, None, "admin")],
        "id string, request_id int, set_fields array<string>, last_name string, first_name string, extra string, "
        "actor_id string")
    ch = M.patch_rows(cur, patches, "employees")
    new = {r.id: r for r in ch.table.collect()}
    assert new["U1"].first_name is None and new["U1"].last_name == "A"
    assert new["U1"].extra == '{"a":1,"b":3,"c":4}'
    assert new["U2"].last_name == "C"
    assert dict(rows(ch.rejected, "id", "reason")) == {"U2": "no_data", "U9": "not_found"}
    audit = ch.audit.first()
    import json
    changes = json.loads(audit.changes)
    assert set(changes) == {"first_name", "extra"}          # last_name unchanged -> not recorded
    assert changes["first_name"] == {"old": "B", "new": None}
    assert changes["extra"] == {"old": {"a": 1, "b": 2}, "new": {"b": 3, "c": 4}}


def test_patches_of_one_row_apply_in_order(spark):
    import json
    cur = frame(spark, "employees", [{"id": "U1", "last_name": "A", "first_name": "F", "extra": '{"b":2,"a":1}'}])
    p = spark.createDataFrame(
        [("U1", 3, ["last_name"], "C", None, '{"c":4}'), ("U1", 2, ["last_name", "first_name"], "B", None, '{"b":3}'),
         ("U1", 4, ["last_name"], "C", None, '{}'), ("U1", 5, ["first_name"], None, "G", '{"a":1, "b":3, "c":4}')],
        "id string, request_id int, set_fields array<string>, last_name string, first_name string, extra string")
    ch = M.patch_rows(cur, p, "employees", actor=None)
    r = ch.table.first()
    assert (r.last_name, r.first_name, json.loads(r.extra)) == ("C", "G", {"a": 1, "b": 3, "c": 4})
    got = [json.loads(a.changes) for a in ch.audit.collect()]
    names = sorted((c["last_name"]["old"], c["last_name"]["new"]) for c in got if "last_name" in c)
    assert names == [("A", "B"), ("B", "C")] and rows(ch.rejected) == []
    last = next(c for c in got if c.get("first_name", {}).get("new") == "G")
    assert "extra" not in last           # the same members in another order are no change
    assert {"first_name": {"old": None, "new": "G"}} == last
    empty = M.patch_rows(cur.limit(0), p.limit(0), "employees", actor=None)
    assert rows(empty.table) == rows(empty.audit) == []


def test_upserts(spark):
    cur = spark.createDataFrame([("s1", "W1", "I1", "", 5)],
                                "id string, warehouse_id string, siz_item_id string, size_value string, quantity int")
    d = spark.createDataFrame([("W1", "I1", "", 2), ("W2", "I1", "", 3), ("W1", "I1", "", 1)],
                              "warehouse_id string, siz_item_id string, size_value string, quantity int")
    k = ["warehouse_id", "siz_item_id", "size_value"]
    a = rows(M.upsert_add(cur, d, k), "warehouse_id", "quantity")
    b = rows(M.upsert_add(cur, d.orderBy(F.desc("quantity")), k), "warehouse_id", "quantity")
    assert a == b == [("W1", 8), ("W2", 3)]
    assert rows(M.upsert_add(cur, d, k).where("warehouse_id = 'W1'"), "id") == [("s1",)]

    norms = frame(spark, "position_siz_norms", [{"id": "n1", "position_id": "P", "siz_item_id": "I", "quantity": 4,
                                                  "issue_period_months": 6, "extra": "{}", "is_active": False}])
    req = spark.createDataFrame([(1, "P", "I", 0, 0, None), (2, "P", "J", 3, 24, '{"x":1}')],
                                "request_id int, position_id string, siz_item_id string, quantity int, "
                                "issue_period_months int, extra string")
    got = {r.siz_item_id: (r.id, r.quantity, r.issue_period_months, r.is_active)
           for r in M.upsert_norms(norms, req).collect()}
    assert got["I"] == ("n1", 1, 12, True)                  # defaults, re-activated, id kept
    assert got["J"][1:] == (3, 24, True)

    once = M.insert_absent(cur.select("warehouse_id", "siz_item_id", "size_value", "quantity"), d, k)
    twice = M.insert_absent(once, d, k)
    assert rows(once) == rows(twice) and len(rows(once)) == 2


def test_soft_and_hard_delete_and_set_quantity(spark):
    cur = frame(spark, "warehouse_stock", [{"id": "s1", "warehouse_id": "W1", "siz_item_id": "I", "quantity": 5},
                                           {"id": "s2", "warehouse_id": "W1", "siz_item_id": "J", "quantity": 1}])
    ids = spark.createDataFrame([("s1", "u"), ("s9", "u")], "id string, actor_id string")
    hd = M.hard_delete(cur, ids, "warehouse_stock")
    assert rows(hd.table, "id") == [("s2",)] and rows(hd.rejected, "id") == [("s9",)]
    assert '"deleted_entry":{"id":"s1"' in hd.audit.first().changes
    req = spark.createDataFrame([("s1", "W1", 9, None, "u"), ("s2", "W2", 1, "x", "u"), ("s2", "W1", -1, "x", "u")],
                                "id string, warehouse_id string, quantity int, notes string, actor_id string")
    sq = M.set_quantity(cur, req)
    assert dict(rows(sq.table, "id", "quantity")) == {"s1": 9, "s2": 1}
    assert rows(sq.rejected, "id", "reason") == [("s2", "invalid"), ("s2", "not_found")]
    assert '"notes":"Ручная корректировка"' in sq.audit.first().changes
    wh = frame(spark, "warehouses", [{"id": "W1", "is_active": True}])
    sd = M.soft_delete(wh, spark.createDataFrame([("W1", "u"), ("W7", "u")], "id string, actor_id string"),
                       "warehouses")
    assert rows(sd.table, "id", "is_active") == [("W1", False)] and rows(sd.rejected, "id") == [("W7",)]


def test_checks(spark):
    df = spark.createDataFrame([("1", "ia", "E1"), ("2", "boss", None), ("3", None, "E9")],
                               "id string, level string, enterprise_id string")
    good, bad = K.check_values(df, "level", K.ALLOWED_VALUES["roles.level"])
    assert rows(bad, "id") == [("2",)] and len(rows(good)) == 2
    parent = spark.createDataFrame([("E1",)], "id string")
    good, bad = K.check_references(df, "enterprise_id", parent)
    assert rows(bad, "id") == [("3",)] and rows(good, "id") == [("1",), ("2",)]
    good, bad = K.check_required(df, ["level", "enterprise_id"])
    assert rows(good, "id") == [("1",)]
    assert rows(K.check_unique(df.union(df), ["id"]), "id", "occurrences")[0] == ("1", 2)


def test_imports(spark, scratch):
    items = frame(spark, "import_items", [
        {"name": "a", "exploitation_months": "12abc"}, {"name": "b", "exploitation_years": "1.5"},
        {"name": "c", "exploitation_months": "x"}, {"name": "", "exploitation_months": "3"},
        {"name": "d", "exploitation_years": "0.04"}, {"name": "e", "unit": "пара"},
        {"name": "f", "exploitation_years": "999999999"}])
    out = I.import_items(items)
    got = {r.name: (r.exploitation_months, None if r.exploitation_years is None else float(r.exploitation_years),
                    r.unit) for r in out["rows"].collect()}
    assert got == {"a": (12, 1.0, "шт"), "b": (18, 1.5, "шт"), "d": (0, None, "шт"), "e": (None, None, "пара")}
    assert rows(out["rejected"], "name") == [("c",), ("f",)]
    assert rows(I.import_items(items, mode="all_or_nothing")["rows"]) == []
    emp = I.import_employees(frame(spark, "import_employees", [{"last_name": "X", "first_name": "", "shoe_size": "0"},
                                                                {"last_name": ""}]))
    r = emp["rows"].first()
    assert (r.first_name, r.shoe_size) == (None, "0")
    assert '"count":1' in emp["audit"].first().changes
    p = f"{scratch}/payload"
    import os
    os.makedirs(p)
    with open(f"{p}/a.json", "w") as f:
        f.write('{"warehouse_id":"W1","rows":[{"siz_item_id":"I1","size_value":"42","quantity":3},'
                '{"siz_item_id":0,"size_value":"0","quantity":"0"}]}')
    df = read_import(spark, p, "import_stock")
    assert rows(df, "warehouse_id", "siz_item_id", "quantity") == [("W1", "I1", "3"), ("W1", None, "0")]
    os.makedirs(f"{p}2")
    with open(f"{p}2/a.json", "w") as f:
        f.write('{"warehouse_id":"W1","rows":[]}')
    try:
        read_import(spark, f"{p}2", "import_stock")
        raise AssertionError("empty payload accepted")
    except EmptyPayload:
        pass
