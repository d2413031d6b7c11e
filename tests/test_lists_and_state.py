import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from equipledger.operators import changes as M
from equipledger.operators import reports as R
from equipledger.operators import scope as S
from equipledger.operators import seeds as SD
from equipledger.schemas import empty
from equipledger.sources.imports import read_import, read_import_documents
from equipledger.sources.tables import append_ledger
from tests.conftest import plan_text, rows
from tests.fixtures import frame


def test_russian_order_under_a_limit(spark):
    names = ["яма", "Ёлка", "ель", "ёлка", "Еда", None, "ясень"]
    df = spark.createDataFrame([(n,) for n in names], "last_name string").withColumn("first_name", F.lit("x"))
    assert [r.last_name for r in R.in_report_order(df, "employees").collect()] == ["Еда", "ёлка", "Ёлка", "ель", "яма", "ясень", None]
    top = R.in_report_order(df, "employees", 2)
    assert [r.last_name for r in top.collect()] == ["Еда", "ёлка"] and "TakeOrderedAndProject" in plan_text(top)


def test_seeds_and_size_list(spark):
    none = {n: empty(spark, n) for n in ("siz_categories", "organizations", "size_references")}
    once = SD.seed(spark, none)
    assert [once[n].count() for n in none] == [6, 1, 54]
    twice = SD.seed(spark, once)
    assert [twice[n].count() for n in none] == [6, 1, 54]
    other = SD.seed(spark, {**none, "siz_categories": frame(spark, "siz_categories", [{"id": "1", "name": "a", "code": "a"}])})
    assert rows(other["siz_categories"], "code") == [("a",)]
    shoes = SD.sizes_report(once["size_references"], "shoes").collect()
    assert [(r.size_value, r.sort_order) for r in shoes] == [(str(34 + i), i) for i in range(1, 16)]
    clothes = SD.sizes_report(once["size_references"], "clothing").collect()
    assert (clothes[0].size_value, clothes[-1].size_value) == ("40-42/158-164", "72-74/194-200")


def test_audit_of_a_hot_id_in_blocks(spark):
    cur = frame(spark, "employees", [{"id": "1", "last_name": "a", "extra": '{"n":0}'}, {"id": "2", "last_name": "b", "extra": "{}"}])
    patches = [("1", i, ["last_name"] if i % 3 else [], f"n{i // 2}", None if i % 4 else json.dumps({"n": i, f"m{i % 5}": i})) for i in range(60)]
    patches += [("2", 100, ["last_name"], "c", None)]
    df = spark.createDataFrame(patches, "id string, request_id long, set_fields array<string>, last_name string, extra string").withColumn("actor_id", F.lit("u"))
    one, cut = (M.patch_rows(cur, df, "employees", block_rows=n) for n in (10**6, 7))
    assert rows(one.table, "id", "last_name", "extra") == rows(cut.table, "id", "last_name", "extra")
    assert rows(one.audit, "id", "changes") == rows(cut.audit, "id", "changes") and one.audit.count() > 40
    assert not [p for p in plan_text(cut.audit).splitlines() if "Window" in p and "[id#" in p and "__block" not in p and "__req" in p]


def test_corrections_of_a_hot_row_in_blocks(spark):
    stock = spark.createDataFrame([("s", "W", 5)], "id string, warehouse_id string, quantity int")
    req = spark.createDataFrame([("s", "W", i, (i * 7) % 11, "") for i in range(40)], "id string, warehouse_id string, request_id long, quantity int, notes string")
    one, cut = (M.set_quantity(stock, req, actor=None, block_rows=n) for n in (100, 3))
    old = lambda ch: sorted(r.changes for r in ch.audit.collect())
    assert old(one) == old(cut) and rows(cut.table, "quantity") == [(39 * 7 % 11,)]
    # uncut: one window over the written rows; cut: the carry is joined on the columns that the rows are dealt by
    assert "__block" not in plan_text(one.audit) and "Join" not in plan_text(one.audit)
    assert "hashpartitioning(coalesce(" not in plan_text(cut.audit)


def test_repeated_delete_requests_are_one(spark):
    cur = frame(spark, "positions", [{"id": "p", "is_active": True}])
    ids = spark.createDataFrame([("p", "u"), ("p", "u"), ("q", "u")], "id string, actor_id string")
    ch = M.soft_delete(cur, ids, "positions")
    assert ch.audit.count() == 1 and rows(ch.table, "is_active") == [(False,)] and rows(ch.rejected, "id") == [("q",)]


def test_scope_classes_of_actors(spark):
    actors = spark.createDataFrame([("1", "ia", None, None), ("2", "enterprise", "E1", None), ("3", "spbipk", "E1", None), ("4", "res", "E1", "R1"),
                                    ("5", "res", None, None), ("6", "enterprise", None, None)],
                                   "id string, role_level string, enterprise_id string, res_unit_id string")
    cards = spark.createDataFrame([("a", "E1", "R1", "warehouse", "spbipk"), ("b", "E1", "R2", "warehouse", "spbipk"), ("c", "E1", "R2", "warehouse", "res"),
                                   ("d", "E2", "R1", "employee", None), ("e", None, None, "employee", None)],
                                  "id string, enterprise_id string, res_unit_id string, source_type string, warehouse_type string")
    members, classes = S.scope_classes(actors, "cards")
    assert len({r.scope_class for r in members.where("actor_id in ('2', '3')").collect()}) == 1
    seen = S.visible_rows(cards, "cards", classes).join(members, "scope_class")
    for a in actors.collect():
        want = rows(S.row_scope(cards, "cards", a.asDict()), "id")
        assert rows(seen.where(F.col("actor_id") == a["id"]), "id") == want


def test_newest_months_of_a_ledger(spark, scratch):
    audit = [{"id": f"{m:02d}{d}", "table_name": "x" if m % 2 else "y", "created_at": dt.datetime(2024, m, d)} for m in range(1, 13) for d in range(1, 4)]
    append_ledger(frame(spark, "audit_log", audit[::2]), scratch, "audit_log", 0)
    append_ledger(frame(spark, "audit_log", audit[1::2]), scratch, "audit_log", 1)
    top = R.latest_of_ledger(spark, scratch, "audit_log", 4)
    assert [r.id for r in top.collect()] == ["123", "122", "121", "113"]
    filters = [x for x in plan_text(top).splitlines() if "PartitionFilters" in x]
    assert filters and all("2024-10" in x for x in filters)      # one month, then two more
    some = R.latest_of_ledger(spark, scratch, "audit_log", 7, {"table_name": "x"})
    assert [r.id for r in some.collect()] == ["113", "112", "111", "093", "092", "091", "073"]
    append_ledger(frame(spark, "audit_log", [{"id": "none", "created_at": None}]), scratch, "audit_log", 2)
    assert [r.id for r in R.latest_of_ledger(spark, scratch, "audit_log", 2).collect()] == ["none", "123"]


def test_payload_documents_have_outcomes_of_their_own(spark, scratch):
    texts = {"good": '{"rows": [{"name": "x", "code": 0}, {"name": 5}], "warehouse_id": "W"}', "bad": '{"rows": [{"name": ', "empty": '{"rows": []}',
             "none": "{}", "list": "[1]", "text": '{"rows": "x"}', "blank": ""}
    os.makedirs(f"{scratch}/p")
    for n, text in texts.items():
        with open(f"{scratch}/p/{n}.json", "w") as f:
            f.write(text)
    got, outcomes = read_import_documents(spark, f"{scratch}/p", "import_positions")
    assert rows(got, "name", "code") == [("5", None), ("x", None)] or rows(got, "name", "code") == [("x", None), ("5", None)]
    found = {os.path.basename(r.document)[:-5]: (r.outcome, r.rows) for r in outcomes.collect()}
    assert found["good"] == ("parsed", 2)
    assert {n for n, (o, _) in found.items() if o == "empty"} == {"empty", "none"}
    assert {n for n, (o, _) in found.items() if o == "corrupt"} >= {"bad", "list", "text"}
    with pytest.raises(Exception):
        read_import(spark, f"{scratch}/p", "import_positions").collect()
