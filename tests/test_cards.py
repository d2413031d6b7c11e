
from equipledger.operators import cards as C
from equipledger.operators import filters as FL
from tests.conftest import plan_text, rows
from tests.fixtures import D, frame, org

AS_OF = "2024-06-01"


def tables(spark):
    t = org(spark)
    t["warehouse_stock"] = frame(spark, "warehouse_stock", [
        {"id": "s1", "warehouse_id": "W1", "siz_item_id": "I1", "size_value": "", "quantity": 5},
        {"id": "s2", "warehouse_id": "W2", "siz_item_id": "I1", "size_value": "", "quantity": 3},
        {"id": "s3", "warehouse_id": "W1", "siz_item_id": "I2", "size_value": "", "quantity": 0}])
    # I1 lasts 1 month: starts chosen so that ends fall on as_of-1, as_of, as_of+30, as_of+31.
    t["employee_siz"] = frame(spark, "employee_siz", [
        {"id": "h1", "employee_id": "U1", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2024-04-30"),
         "exploitation_start": D("2024-04-30"), "status": "active", "from_warehouse_id": "W1"},   # end 05-30
        {"id": "h2", "employee_id": "U1", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2024-05-01"),
         "exploitation_start": D("2024-05-01"), "status": "active", "from_warehouse_id": "W1"},   # end 06-01
        {"id": "h3", "employee_id": "U2", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2024-06-01"),
         "exploitation_start": D("2024-06-01"), "status": "active"},                               # end 07-01
        {"id": "h4", "employee_id": "U2", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2024-06-02"),
         "exploitation_start": D("2024-06-02"), "status": "active"},                               # end 07-02
        {"id": "h5", "employee_id": "U2", "siz_item_id": "I2", "quantity": 1, "issued_date": D("2020-01-01"),
         "exploitation_start": D("2020-01-01"), "status": "active"},                               # no months
        {"id": "h6", "employee_id": "U3", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2020-01-01"),
         "exploitation_start": None, "status": "active"},                                          # no start
        {"id": "h7", "employee_id": "U3", "siz_item_id": "I1", "quantity": 1, "issued_date": D("2020-01-01"),
         "exploitation_start": D("2020-01-01"), "status": "returned"}])
    return t


def test_cards_rows_and_status(spark):
    cards = C.equipment_cards(tables(spark), AS_OF)
    assert len(cards.columns) == 29
    got = {r.id: (r.source_type, r.status, r.exploitation_end) for r in cards.collect()}
    assert set(got) == {"s1", "s2", "h1", "h2", "h3", "h4", "h5", "h6"}   # qty 0 and returned rows excluded
    assert got["h1"] == ("employee", "expired", D("2024-05-30"))
    assert got["h2"][1] == "issued" and got["h2"][2] == D("2024-06-01")
    assert got["h5"][1:] == ("issued", None)
    assert got["h6"][1:] == ("issued", None)
    assert got["s1"][:2] == ("warehouse", "in_stock")


def test_warehouse_enterprise_through_spbipk(spark):
    cards = C.equipment_cards(tables(spark), AS_OF)
    r = {x.id: x for x in cards.where("source_type = 'warehouse'").collect()}
    assert (r["s1"].enterprise_id, r["s1"].enterprise_fk, r["s1"].enterprise_name) == ("E1", "E1", "Ent 1")
    # Reached only through its spbipk: raw enterprise_id stays NULL, the resolved one is E1.
    assert (r["s2"].enterprise_id, r["s2"].enterprise_fk, r["s2"].enterprise_name) == (None, "E1", "Ent 1")


def test_card_stats_invariants(spark):
    cards = C.equipment_cards(tables(spark), AS_OF)
    s = C.card_stats(cards, AS_OF).first()
    assert s.total == s.in_stock + s.issued + s.expired
    assert (s.total, s.in_stock, s.issued, s.expired, s.expiring_soon) == (8, 2, 5, 1, 2)   # h2 (as_of), h3 (+30)


def test_filters_by_status_and_place(spark):
    cards = C.equipment_cards(tables(spark), AS_OF)
    assert rows(FL.cards_by_status(cards, "expiring_soon", AS_OF), "id") == [("h2",), ("h3",)]
    assert rows(FL.cards_by_status(cards, "expired", AS_OF), "id") == [("h1",)]
    assert len(rows(FL.cards_by_status(cards, "in_stock", AS_OF), "id")) == 2
    assert len(rows(FL.cards_by_status(cards, "bogus", AS_OF), "id")) == 8
    assert rows(FL.cards_by_place(cards, "spbipk"), "id") == [("s1",), ("s2",)]


def test_place_filter_prunes_a_branch(spark):
    """A source_type test removes the other branch of the union from the optimised plan."""
    cards = C.equipment_cards(tables(spark), AS_OF)
    plan = plan_text(FL.cards_by_place(cards, "employee"))
    assert "warehouse_stock" not in plan.lower() or plan.count("Union") == 0
    assert "Union" not in plan


def test_cards_scope_res_actor(spark):
    """res actors see their unit's rows plus stock of non-'res' warehouses of their enterprise (raw
    enterprise_id); statistics use the narrower res-unit rule."""
    from equipledger.operators.scope import row_scope
    cards = C.equipment_cards(tables(spark), AS_OF)
    actor = {"role_level": "res", "res_unit_id": "R1", "enterprise_id": "E1"}
    seen = rows(row_scope(cards, "cards", actor), "id")
    # h1/h2 belong to U1 (res unit R1); s1 is in W1 (type spbipk, raw enterprise E1); s2 reaches E1 only through
    # its spbipk, so its raw enterprise_id is NULL and it stays invisible.
    assert seen == [("h1",), ("h2",), ("s1",)]
    stats = rows(row_scope(cards, "card_stats", actor), "id")
    assert stats == [("h1",), ("h2",)]
    assert rows(row_scope(cards, "cards", {"role_level": "enterprise", "enterprise_id": "E1"}), "id") == \
        [("h1",), ("h2",), ("h3",), ("h4",), ("h5",), ("s1",)]
