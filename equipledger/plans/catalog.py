"""Registered queries: each operator of SURVEY §2 run over the driver's tables mapped to the domain.

Every entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole mapped tables; the matching DuckDB
text is in ``equipledger.plans.oracle.ORACLE`` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from pyspark.sql import functions as F

from equipledger.operators import cards as C
from equipledger.operators import changes as M
from equipledger.operators import checks as K
from equipledger.operators import imports as I
from equipledger.operators import filters as FL
from equipledger.operators import ledger as L
from equipledger.operators import nested as N
from equipledger.operators import reports as R
from equipledger.operators import scope as S
from equipledger.operators import seeds as SD
from equipledger.session import apply_conf
from equipledger.schemas import empty
from equipledger.sources.mapping import AS_OF, IMPORT_DAY, IMPORT_WAREHOUSE, MappedTables

_tables: dict[tuple[int, str], MappedTables] = {}


def tables(spark: SparkSession, sf_dir: str) -> MappedTables:
    """Mapped tables of ``sf_dir``, built once per session (plans, not data)."""
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _tables:
        apply_conf(spark)
        _tables[key] = MappedTables(spark, sf_dir)
    return _tables[key]


def equipment_cards(spark, sf_dir):
    return tables(spark, sf_dir).derived("cards", lambda t: C.equipment_cards(t, AS_OF))


def _core(spark, sf_dir):
    return tables(spark, sf_dir).derived("core", lambda t: C.card_core(t, AS_OF))


def card_stats(spark, sf_dir):
    return C.card_stats(_core(spark, sf_dir), AS_OF)


def card_stats_by_enterprise(spark, sf_dir):
    return C.card_stats(_core(spark, sf_dir), AS_OF, by=["enterprise_id"])


def cards_expiring_soon(spark, sf_dir):
    return FL.cards_by_status(equipment_cards(spark, sf_dir), "expiring_soon", AS_OF)


def cards_stock_by_type(spark, sf_dir):
    return FL.cards_by_place(equipment_cards(spark, sf_dir), "spbipk")


def cards_expired(spark, sf_dir):
    return FL.cards_by_status(equipment_cards(spark, sf_dir), "expired", AS_OF)


def cards_issued(spark, sf_dir):
    return FL.cards_by_status(equipment_cards(spark, sf_dir), "issued", AS_OF)


def cards_search(spark, sf_dir):
    """F3 on the card view: item name, item code or employee surname contains the text (case-insensitive)."""
    return FL.search(equipment_cards(spark, sf_dir), "RING", ["item_name", "item_code", "last_name"]).select(
        "id", "source_type", "item_name", "item_code", "last_name", "status")


def employees_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.employees_report(t, text="customer#0000001").select("id", "last_name", "employee_number",
                                                                   "position_name", "enterprise_name")


# ---------------------------------------------------------------- reports

def categories_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.categories_report(t["siz_categories"], t["siz_items"]).select("id", "name", "items_count")


def items_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.items_report(t["siz_items"], t["siz_categories"]).select(
        "id", "name", "code", "category_id", "category_name", "category_code")


def items_search(spark, sf_dir):
    """F3 with wildcards kept: '_' matches any one character, matching is case-insensitive."""
    t = tables(spark, sf_dir)
    return R.items_report(t["siz_items"], t["siz_categories"], text="BRAND#1_").select(
        "id", "name", "code", "category_name")


def position_norms(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.position_norms(t["position_siz_norms"], t["siz_items"], t["siz_categories"]).select(
        "id", "position_id", "siz_item_id", "quantity", "issue_period_months", "item_name", "unit",
        "wear_period_months", "category_name")


def norm_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.norm_report(t["position_siz_norms"], t["positions"], t["siz_items"], t["siz_categories"])


def entitlements(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.entitlements(t["employees"], t["position_siz_norms"], t["siz_items"], t["siz_categories"])


def entitlement_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.entitlement_counts(t["employees"], t["position_siz_norms"], t["siz_items"])


def positions_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.positions_report(t["positions"], t["position_siz_norms"], t["employees"], t["enterprises"],
                              t["res_units"], t["departments"]).select(
        "id", "name", "norms_count", "employees_count", "enterprise_name", "res_name", "department_name")


def enterprises_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.enterprises_report(t["enterprises"], t["organizations"]).select(
        "id", "name", "organization_id", "organization_name")


def spbipk_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.spbipk_report(t["spbipk"], t["enterprises"]).select("id", "name", "enterprise_id", "enterprise_name")


def res_units_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.res_units_report(t["res_units"], t["enterprises"], t["spbipk"]).select(
        "id", "name", "enterprise_id", "spbipk_id", "enterprise_name", "spbipk_name")


def departments_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.departments_report(t["departments"], t["res_units"]).select("id", "name", "res_unit_id", "res_name")


def users_report(spark, sf_dir):
    return R.users_report(tables(spark, sf_dir)).select(
        "id", "username", "full_name", "is_active", "role_id", "enterprise_id", "res_unit_id", "role_level",
        "enterprise_name", "res_name")


def warehouses_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.warehouses_report(t["warehouses"], t["spbipk"], t["res_units"], t["enterprises"]).select(
        "id", "name", "warehouse_type", "enterprise_id", "spbipk_name", "res_name", "enterprise_name")


def employees_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.employees_report(t).select("id", "last_name", "position_id", "enterprise_id", "position_name",
                                        "res_name", "enterprise_name", "department_name")


def stock_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.stock_report(t["warehouse_stock"], t["siz_items"], t["siz_categories"])


def stock_totals(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.stock_totals(t["warehouses"], t["warehouse_stock"])


def holdings_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.holdings_report(t["employee_siz"], t["siz_items"], t["siz_categories"], t["warehouses"]).select(
        "id", "employee_id", "siz_item_id", "size_value", "quantity", "issued_date", "exploitation_start",
        "status", "from_warehouse_id", "item_name", "item_code", "unit", "exploitation_months",
        "exploitation_years", "category_name", "warehouse_name", "exploitation_end")


def movement_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.movement_report(t).select(
        "id", "movement_type", "siz_item_id", "quantity", "from_warehouse_id", "to_warehouse_id", "employee_id",
        "movement_date", "item_name", "unit", "category_name", "from_warehouse_name", "to_warehouse_name",
        "last_name", "first_name", "middle_name", "moved_by_name")


def latest_movements(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.latest_movements(t["stock_movements"], 200).select(
        "warehouse_id", "id", "movement_type", "quantity", "created_at", "rank")


def movement_page(spark, sf_dir):
    """O3 + J5: the newest 200 movements of every warehouse with their labels."""
    return R.movement_page(tables(spark, sf_dir)).select(
        "warehouse_id", "rank", "id", "movement_type", "quantity", "movement_date", "item_name", "unit",
        "category_name", "from_warehouse_name", "to_warehouse_name", "last_name", "moved_by_name")


def warehouse_staff_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.warehouse_staff_counts(t["warehouses"], t["employees"])


def latest_audit(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.audit_report(t["audit_log"], t["users"]).select(
        "id", "user_id", "table_name", "action", "changes", "created_at", "user_name", "username")


def latest_audit_employees(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.audit_report(t["audit_log"], t["users"], table_name="employees").select(
        "id", "user_id", "table_name", "action", "changes", "created_at", "user_name", "username")


def org_tree_nodes(spark, sf_dir):
    return N.org_tree_nodes(tables(spark, sf_dir))


def employee_norm_summary(spark, sf_dir):
    return N.employee_norm_summary(tables(spark, sf_dir))


# ---------------------------------------------------------------- scope and admission

def card_stats_per_actor(spark, sf_dir):
    """F4 + F5 + A2 for every active actor at once: one grouping-sets aggregate over the cards (per enterprise,
    per res unit, total), joined to the actors by their scope key; no actor x card pairs."""
    t = tables(spark, sf_dir)
    stats = C.card_stats_by_scope(_core(spark, sf_dir), AS_OF)
    return S.stats_per_actor(stats, S.actor_context(t["users"], t["roles"]), C.STAT_COLUMNS)


def admit_requests(spark, sf_dir):
    t = tables(spark, sf_dir)
    actors = S.actor_context(t["users"], t["roles"])
    return S.admit_requests(t.admission_requests(), actors).select(
        "request_id", "actor_id", "operation", "admitted", "refusal")


def admit_all_operations(spark, sf_dir):
    """G1 over all operations of the rules, and one that no rule names."""
    t = tables(spark, sf_dir)
    return S.admit_requests(t.all_operation_requests(), S.actor_context(t["users"], t["roles"])).select(
        "request_id", "actor_id", "operation", "admitted", "refusal")


# One actor of each lower level, for the lists an actor sees.
RES_ACTOR = {"role_level": "res", "enterprise_id": "3", "res_unit_id": "R3-1"}
SPBIPK_ACTOR = {"role_level": "spbipk", "enterprise_id": "3", "res_unit_id": None}


def cards_of_res_actor(spark, sf_dir):
    """Own res unit's cards, and the stock of the enterprise's warehouses that are not of a res unit."""
    return S.row_scope(equipment_cards(spark, sf_dir), "cards", RES_ACTOR)


def employees_of_res_actor(spark, sf_dir):
    return S.row_scope(R.employees_report(tables(spark, sf_dir)), "employees", RES_ACTOR).select(
        "id", "last_name", "enterprise_id", "res_unit_id", "res_name", "department_name")


def warehouses_of_spbipk_actor(spark, sf_dir):
    t = tables(spark, sf_dir)
    w = R.warehouses_report(t["warehouses"], t["spbipk"], t["res_units"], t["enterprises"])
    return S.row_scope(w, "warehouses", SPBIPK_ACTOR).select("id", "name", "warehouse_type", "spbipk_name", "res_name")


def transactions_of_res_actor(spark, sf_dir):
    return S.row_scope(R.transaction_report(tables(spark, sf_dir)), "transactions", RES_ACTOR).select(
        "id", "employee_id", "transaction_type", "quantity", "employee_enterprise_id", "employee_res_unit_id")


def org_tree_of_res_actor(spark, sf_dir):
    return N.org_tree_nodes(tables(spark, sf_dir), RES_ACTOR)


# ---------------------------------------------------------------- ledger

def _ledger(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.apply_movements(t.opening_stock(), empty(spark, "employee_siz"), t["movement_events"],
                             t["siz_items"], materialize=False)


def ledger_decisions(spark, sf_dir):
    """L9 decisions for every movement event, judged in (event_time, event_id) order per stock key."""
    t = tables(spark, sf_dir)
    return L.decide(t.opening_stock(), empty(spark, "employee_siz"), t["movement_events"])


def ledger_stock(spark, sf_dir):
    return _ledger(spark, sf_dir).stock.select("warehouse_id", "siz_item_id", "size_value", "quantity")


def ledger_holdings(spark, sf_dir):
    return _ledger(spark, sf_dir).holdings.select(
        "id", "employee_id", "siz_item_id", "quantity", "issued_date", "exploitation_start", "status",
        "from_warehouse_id")


def ledger_movements(spark, sf_dir):
    return _ledger(spark, sf_dir).movements.select(
        "id", "movement_type", "siz_item_id", "quantity", "from_warehouse_id", "to_warehouse_id", "employee_id",
        "movement_date")


def _mixed(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.apply_movements(t.opening_stock(), empty(spark, "employee_siz"), t.mixed_movement_events(),
                             t["siz_items"], materialize=False)


def ledger_kinds_decisions(spark, sf_dir):
    """L9 over all six kinds of events (L1-L6), with every reason of refusal."""
    t = tables(spark, sf_dir)
    return L.decide(t.opening_stock(), empty(spark, "employee_siz"), t.mixed_movement_events())


def ledger_kinds_stock(spark, sf_dir):
    return _mixed(spark, sf_dir).stock.select("warehouse_id", "siz_item_id", "size_value", "quantity")


def ledger_kinds_holdings(spark, sf_dir):
    return _mixed(spark, sf_dir).holdings.select("id", "employee_id", "siz_item_id", "quantity", "issued_date", "status",
                                                 "returned_date", "from_warehouse_id")


def ledger_kinds_movements(spark, sf_dir):
    return _mixed(spark, sf_dir).movements.select("id", "movement_type", "siz_item_id", "quantity", "from_warehouse_id",
                                                  "to_warehouse_id", "employee_id", "movement_date")


def ledger_kinds_audit(spark, sf_dir):
    """Audit rows of the accepted resets (old and new quantity) and movements."""
    part = lambda p: F.get_json_object("changes", p).cast("int")
    return _mixed(spark, sf_dir).audit.select(
        "table_name", "action", "created_at", part("$.old_quantity").alias("old_quantity"),
        part("$.new_quantity").alias("new_quantity"), part("$.deleted_entry.quantity").alias("deleted_quantity"))


def _import(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.import_stock(t.import_stock_rows(), t["siz_items"], IMPORT_WAREHOUSE, today=IMPORT_DAY)


def import_stock_deltas(spark, sf_dir):
    return _import(spark, sf_dir)["deltas"]


def import_stock_summary(spark, sf_dir):
    return _import(spark, sf_dir)["summary"]


def import_stock_movements(spark, sf_dir):
    return _import(spark, sf_dir)["movements"].select(
        "movement_type", "siz_item_id", "size_value", "quantity", "to_warehouse_id", "document_reference", "notes",
        "movement_date")


def retire_ia_warehouses(spark, sf_dir):
    """L8 + M3: retire every central ('ia') warehouse; refused while its stock sums to > 0."""
    t = tables(spark, sf_dir)
    req = t["warehouses"].where(F.col("warehouse_type") == "ia").select("id")
    return L.retire_warehouses(t["warehouses"], t["warehouse_stock"], req)["warehouses"].select("id", "is_active")


# ---------------------------------------------------------------- changes, checks, imports

def norms_upsert(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.upsert_norms(t["position_siz_norms"], t.norm_requests()).select(
        "position_id", "siz_item_id", "quantity", "issue_period_months", "extra", "is_active")


def stock_upsert_returns(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.upsert_add(t["warehouse_stock"], t.return_deltas(), ["warehouse_id", "siz_item_id", "size_value"]) \
        .select("warehouse_id", "siz_item_id", "size_value", "quantity")


def patch_employees(spark, sf_dir):
    t = tables(spark, sf_dir)
    ch = M.patch_rows(t["employees"], t.employee_patches(), "employees")
    return ch.table.select("id", "last_name", "enterprise_id", "extra")


def patch_employees_audit(spark, sf_dir):
    t = tables(spark, sf_dir)
    ch = M.patch_rows(t["employees"], t.employee_patches(), "employees")
    keys = F.array_join(F.array_sort(F.json_object_keys("changes")), ",")
    return ch.audit.select("record_id", "action", keys.alias("changed_fields"),
                           F.get_json_object("changes", "$.last_name.new").alias("new_last_name"))


def patch_series(spark, sf_dir):
    """M2 with three patches per employee, applied in request order."""
    t = tables(spark, sf_dir)
    ch = M.patch_rows(t["employees"], t.employee_patch_series(), "employees")
    return ch.table.select("id", "last_name", "enterprise_id", "extra")


def patch_series_audit(spark, sf_dir):
    """M2 + D1: the audit row of every patch, against the state that the patches before it left."""
    t = tables(spark, sf_dir)
    return _series_audit(M.patch_rows(t["employees"], t.employee_patch_series(), "employees"))


def _series_audit(ch):
    part = lambda p: F.get_json_object("changes", p)
    return ch.audit.select("record_id", F.array_join(F.array_sort(F.json_object_keys("changes")), ",").alias("fields"),
                           part("$.last_name.old").alias("old_name"), part("$.last_name.new").alias("new_name"),
                           part("$.enterprise_id.old").alias("old_enterprise"),
                           part("$.enterprise_id.new").alias("new_enterprise"),
                           part("$.extra.old").alias("old_extra"), part("$.extra.new").alias("new_extra"))


def adjust_series(spark, sf_dir):
    """M9 with two corrections per stock row: the last valid one stays."""
    t = tables(spark, sf_dir)
    return M.set_quantity(t["warehouse_stock"], t.stock_adjustment_series()).table.select(
        "warehouse_id", "siz_item_id", "quantity")


def adjust_series_audit(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _adjust_audit(M.set_quantity(t["warehouse_stock"], t.stock_adjustment_series()))


def _adjust_audit(ch):
    part = lambda p: F.get_json_object("changes", p).cast("int")
    return ch.audit.select("record_id", part("$.old_quantity").alias("old_quantity"),
                    part("$.new_quantity").alias("new_quantity"))


def norms_insert_first(spark, sf_dir):
    """M7 with two requests per key: the first one is stored."""
    t = tables(spark, sf_dir)
    req = t.norm_request_series().withColumn("is_active", F.lit(True))
    return M.insert_absent(t["position_siz_norms"], req, ["position_id", "siz_item_id"], order="request_id").select(
        "position_id", "siz_item_id", "quantity", "issue_period_months", "is_active")


def import_items_rows(spark, sf_dir):
    out = I.import_items(tables(spark, sf_dir).import_item_rows())["rows"]
    return out.select("name", "code", "category_id", "exploitation_months", "exploitation_years", "unit")


def import_items_rejected(spark, sf_dir):
    return I.import_items(tables(spark, sf_dir).import_item_rows())["rejected"].select("name", "code", "reason")


def import_employees_rows(spark, sf_dir):
    out = I.import_employees(tables(spark, sf_dir).import_employee_rows())["rows"]
    return out.select("last_name", "first_name", "employee_number", "enterprise_id", "position_id")


def check_norm_keys_unique(spark, sf_dir):
    return K.check_unique(tables(spark, sf_dir)["position_siz_norms"], ["position_id", "siz_item_id"])


def check_movement_employees(spark, sf_dir):
    """movements whose employee is not an active employee."""
    t = tables(spark, sf_dir)
    emp = t["employees"].where("is_active")
    return K.check_references(t["stock_movements"].select("id", "employee_id"), "employee_id", emp)[1]


def check_movement_types(spark, sf_dir):
    """movement types outside the allowed list (none expected)."""
    t = tables(spark, sf_dir)
    return K.check_values(t["stock_movements"].select("id", "movement_type"), "movement_type",
                          L.MOVEMENT_KINDS)[1]


def transactions_report(spark, sf_dir):
    """The old transaction feed with employee, item, category and user labels (whole feed)."""
    return R.transaction_report(tables(spark, sf_dir)).select(
        "id", "employee_id", "siz_item_id", "transaction_type", "quantity", "transaction_date", "last_name",
        "employee_number", "item_name", "unit", "category_name", "issued_by_name")


def latest_transactions(spark, sf_dir):
    """J10 + O2 with LIMIT: the newest 100 transactions (ties broken by id, newest first)."""
    t = tables(spark, sf_dir)
    return R.transaction_report(t, limit=100, tie_break="id").select(
        "id", "employee_id", "transaction_type", "quantity", "transaction_date", "last_name", "item_name")


def insert_employees(spark, sf_dir):
    """I1 + M1: imported employees inserted into the employee table (ids from the request number)."""
    t = tables(spark, sf_dir)
    rows = I.import_employees(t.import_employee_rows())["rows"].drop("id")
    rows = rows.withColumn("request_id", F.col("employee_number")).withColumn("actor_id", F.lit("0"))
    ch = M.insert_rows(t["employees"], rows, "employees")
    return ch.table.select("last_name", "first_name", "employee_number", "enterprise_id", "position_id", "extra",
                           "is_active")


def import_positions_rows(spark, sf_dir):
    out = I.import_positions(tables(spark, sf_dir).import_position_rows())["rows"]
    return out.groupBy("name", "code").agg(F.count(F.lit(1)).alias("rows"))


def drop_inactive_stock(spark, sf_dir):
    """M4: stock rows of inactive warehouses removed; the audit keeps each removed row."""
    t = tables(spark, sf_dir)
    ch = M.hard_delete(t["warehouse_stock"], t.empty_stock_rows(), "warehouse_stock")
    return ch.table.select("warehouse_id", "siz_item_id", "quantity")


def adjust_stock(spark, sf_dir):
    """M9: absolute stock corrections; a request naming the wrong warehouse is not found."""
    t = tables(spark, sf_dir)
    ch = M.set_quantity(t["warehouse_stock"], t.stock_adjustments())
    return ch.table.select("warehouse_id", "siz_item_id", "quantity")


def norms_insert_absent(spark, sf_dir):
    """M7: the norm requests inserted only where (position, item) is not stored yet."""
    t = tables(spark, sf_dir)
    req = t.norm_requests().withColumn("is_active", F.lit(True))
    out = M.insert_absent(t["position_siz_norms"], req, ["position_id", "siz_item_id"], order="request_id")
    return out.select("position_id", "siz_item_id", "quantity", "issue_period_months", "is_active")


YEARS = ((None, 1997), (1997, 1999), (1999, None))


def _streamed_years(spark, sf_dir, again=None):
    """The state root after the movement events arrived in three time-ordered parts (before 1997, 1997-1998, from 1999),
    each written in parallel and drained by a run of the same stream. ``again(earlier, part)`` may deliver rows twice."""
    import uuid

    from equipledger.session import checkpoint_dir
    from equipledger.streaming import movements as T

    t = tables(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    year = F.year("event_time")
    within = lambda lo, hi: t["movement_events"].where(
        (year >= lo if lo else F.lit(True)) & (year < hi if hi else F.lit(True)))
    T.seed_state(t.opening_stock(), empty(spark, "employee_siz"), f"{root}/state")
    for i, (lo, hi) in enumerate(YEARS):
        part = within(lo, hi)
        if again:
            part = again(within(*YEARS[i - 1]) if i else None, part)
        part.write.parquet(f"{root}/inbox/chunk={i}", compression="zstd")
        T.stream_movements(spark, f"{root}/inbox/chunk=*", f"{root}/state", t["siz_items"]).awaitTermination()
    return f"{root}/state"


def stream_ledger_stock(spark, sf_dir):
    """Judged part by part, the final stock equals the whole batch applied at once."""
    from equipledger.streaming import movements as T
    return T.final_stock(spark, _streamed_years(spark, sf_dir)).select("warehouse_id", "siz_item_id", "size_value", "quantity")


def _order_of(event):
    return F.substring(event, 1, 12).cast("long")


def stream_repeats_stock(spark, sf_dir):
    """T1 with events delivered twice: orders divisible by 5 twice within a part, those divisible by 7 once more in the next
    part, an hour later and with another quantity. Each id counts once."""
    from equipledger.streaming import movements as T

    def again(earlier, part):
        order = _order_of("event_id")
        out = part.unionByName(part.where(order % 5 == 0))
        if earlier is None:
            return out
        late = earlier.where(order % 7 == 0).withColumn("quantity", F.col("quantity") + 1)
        return out.unionByName(late.withColumn("event_time", F.col("event_time") + F.expr("interval 1 hour")))
    return T.final_stock(spark, _streamed_years(spark, sf_dir, again)).select("warehouse_id", "siz_item_id", "size_value", "quantity")


def ledger_repeats_decisions(spark, sf_dir):
    """L9 on a batch in which rows share ids: orders divisible by 5 are asked for again an hour later, half as much. Rows are judged
    one by one."""
    t = tables(spark, sf_dir)
    return L.decide(t.opening_stock(), empty(spark, "employee_siz"), t.repeated_movement_events())


def ledger_hot_decisions(spark, sf_dir):
    """L9 with one stock key that holds the events of every 60th order and is far larger than ``hot_events``: sure hours whole,
    the rest replayed."""
    t = tables(spark, sf_dir)
    ev = t.hot_movement_events()
    opening = t.opening_stock()
    return L.decide(opening.unionByName(t.hot_opening().join(opening, ["warehouse_id", "siz_item_id", "size_value"], "left_anti")),
                    empty(spark, "employee_siz"), ev, hot_events=50)


# ---------------------------------------------------------------- ordered lists, seeds, checks with content

def employees_ordered(spark, sf_dir):
    """O1: the first 300 employees by surname and first name as Russian orders them (NULLs last), ties by id."""
    e = tables(spark, sf_dir).russian_employees().withColumn("number", F.col("id").cast("long"))
    return R.in_report_order(e, "employees", 300, "number").select("id", "last_name", "first_name")


def items_ordered(spark, sf_dir):
    """O1: the first 200 items by category and name."""
    t = tables(spark, sf_dir)
    return R.in_report_order(R.items_report(t["siz_items"], t["siz_categories"]), "items", 200, "id").select("id", "category_name", "name")


def cards_ordered(spark, sf_dir):
    """O1: the first 200 cards by category, item and size."""
    return R.in_report_order(equipment_cards(spark, sf_dir), "cards", 200, "id").select("id", "category_name", "item_name", "size_value")


def sizes_in_use(spark, sf_dir):
    """The size list with the number of employees who wear each shoe size; the list seeded into a table that holds one of its
    sizes already."""
    t = tables(spark, sf_dir)
    stored = spark.createDataFrame([("old", "shoes", "40", 99)], "id string, category_type string, size_value string, sort_order int")
    sizes = SD.seed(spark, {**{n: empty(spark, n) for n in ("siz_categories", "organizations")}, "size_references": stored})["size_references"]
    worn = t.sized_employees().groupBy(F.col("shoe_size").alias("size_value")).agg(F.count(F.lit(1)).alias("employees"))
    out = SD.sizes_report(sizes).join(worn.withColumn("category_type", F.lit("shoes")), ["category_type", "size_value"], "left")
    return out.select("category_type", "size_value", "sort_order", F.coalesce("employees", F.lit(0)).alias("employees"))


def seeded_categories(spark, sf_dir):
    """M7 with the whole-table condition: the seed categories go into an empty table, not into one that has rows."""
    t = tables(spark, sf_dir)
    none = {n: empty(spark, n) for n in ("organizations", "size_references")}
    stored = SD.seed(spark, {**none, "siz_categories": t["siz_categories"]})["siz_categories"]
    fresh = SD.seed(spark, {**none, "siz_categories": t["siz_categories"].where("is_active is null")})["siz_categories"]
    return stored.select(F.lit("stored").alias("into"), "name").unionByName(fresh.select(F.lit("empty").alias("into"), "name"))


def check_audit_actions(spark, sf_dir):
    """audit rows whose action is outside a list."""
    return K.check_values(tables(spark, sf_dir)["audit_log"].select("id", "action"), "action", ("view", "click", "purchase"))[1]


def import_employees_missing(spark, sf_dir):
    """import rows without a surname, first name or enterprise, with the fields that are missing."""
    return K.check_required(tables(spark, sf_dir).import_employee_rows(), ["last_name", "first_name", "enterprise_id"])[1].select(
        "employee_number", "reason")


def import_positions_repeated(spark, sf_dir):
    """position names that an import repeats."""
    return K.check_unique(tables(spark, sf_dir).import_position_rows(), ["name", "enterprise_id"])


def import_stock_unknown_items(spark, sf_dir):
    """Stock-import rows per item that is missing or inactive."""
    t = tables(spark, sf_dir)
    return R.item_exists(t.import_stock_rows(), t["siz_items"])[1].groupBy("siz_item_id").agg(F.count(F.lit(1)).alias("rows"))


def soft_delete_norms(spark, sf_dir):
    t = tables(spark, sf_dir)
    return M.soft_delete(t["position_siz_norms"], t.norm_deletions(), "position_siz_norms").table.select("id", "is_active")


def soft_delete_norms_audit(spark, sf_dir):
    """M3: an audit row per deleted norm, 'not_found' for the others."""
    t = tables(spark, sf_dir)
    ch = M.soft_delete(t["position_siz_norms"], t.norm_deletions(), "position_siz_norms")
    return ch.audit.select("record_id", F.col("action").alias("outcome")).unionByName(
        ch.rejected.select(F.col("id").alias("record_id"), F.col("reason").alias("outcome")))


def roles_upsert(spark, sf_dir):
    """M8: stored roles take the description of the request and keep their level; new ones are inserted."""
    t = tables(spark, sf_dir)
    out = M.upsert_replace(t["roles"], t.role_requests(), ["name"], "request_id", {"description": F.col("description")}, reactivate=False)
    return out.select("name", "level", "description")


def patch_employees_touched(spark, sf_dir):
    """M2 + M10: patched rows carry the time of the change, the others none."""
    t = tables(spark, sf_dir)
    some = t.employee_patches().where(F.col("request_id") % 2 == 0)
    out = M.patch_rows(t["employees"], some, "employees", updated_at=F.lit("2024-05-01 10:00:00").cast("timestamp"), block_rows=1)
    return out.table.select("id", "last_name", "updated_at")


def insert_employees_ids(spark, sf_dir):
    """Ids derived from the request."""
    t = tables(spark, sf_dir)
    rows = I.import_employees(t.import_employee_rows())["rows"].drop("id").withColumns(
        {"request_id": F.col("employee_number"), "actor_id": F.lit("0")})
    new = M.insert_rows(empty(spark, "employees"), rows, "employees").table
    return new.select("id", "employee_number")


def patch_series_hot_audit(spark, sf_dir):
    """M2 + D1 with the patches of an id cut into blocks of one request: the same audit rows."""
    t = tables(spark, sf_dir)
    return _series_audit(M.patch_rows(t["employees"], t.employee_patch_series(), "employees", block_rows=1))


def adjust_series_hot_audit(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _adjust_audit(M.set_quantity(t["warehouse_stock"], t.stock_adjustment_series(), block_rows=1))


def _by_actor_class(spark, sf_dir, table, df):
    t = tables(spark, sf_dir)
    members, classes = S.scope_classes(S.actor_context(t["users"], t["roles"]), table)
    seen = S.visible_rows(df, table, classes).groupBy("scope_class").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")).alias("mark"))
    actors = S.actor_context(t["users"], t["roles"]).select(F.col("id").alias("actor_id"))
    out = actors.join(members, "actor_id", "left").join(seen, "scope_class", "left")
    return out.select("actor_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("mark", F.lit(0)).alias("mark"))


def cards_of_every_actor(spark, sf_dir):
    """per active actor the number of cards it sees and a mark of which (sum over their ids)."""
    return _by_actor_class(spark, sf_dir, "cards", equipment_cards(spark, sf_dir))


def employees_of_every_actor(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _by_actor_class(spark, sf_dir, "employees", t["employees"].where("is_active"))


def cards_by_scope_class(spark, sf_dir):
    """the rows themselves, once for each set of actors that sees them."""
    t = tables(spark, sf_dir)
    _, classes = S.scope_classes(S.actor_context(t["users"], t["roles"]).where("role_level <> 'ia'"), "cards")
    return S.visible_rows(equipment_cards(spark, sf_dir), "cards", classes).select("scope_class", "id")


def ledger_latest_audit(spark, sf_dir):
    """D3 over S4: the newest 100 rows of the appended audit ledger, read from its newest months only."""
    import uuid

    from equipledger.session import checkpoint_dir
    from equipledger.sources.tables import append_ledger

    t = tables(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    for batch in (0, 1):
        append_ledger(t["audit_log"].where(F.col("id").cast("long") % 2 == batch), root, "audit_log", batch)
    return R.audit_labels(R.latest_of_ledger(spark, root, "audit_log"), t["users"]).select(
        "id", "user_id", "table_name", "action", "changes", "created_at", "user_name", "username")


def import_stock_written(spark, sf_dir):
    """L7 + A4: an import that is written and counted in one job."""
    import uuid

    from equipledger.session import checkpoint_dir

    t = tables(spark, sf_dir)
    rows = L.import_stock(t.import_stock_rows(), t["siz_items"], IMPORT_WAREHOUSE, today=IMPORT_DAY)["rows"]
    counts = I.write_counted(rows, f"{checkpoint_dir(spark).rstrip('/')}/import-{uuid.uuid4().hex}", ("imported", "skipped", "error"))
    return spark.createDataFrame([(k, v) for k, v in counts.items() if v], "outcome string, rows long")


def import_documents(spark, sf_dir):
    """Stock-import rows as request bodies, one per item category of the rows (some cut off, some empty), read back with
    their outcomes: rows and documents per outcome."""
    import uuid

    from equipledger.session import checkpoint_dir
    from equipledger.sources.imports import read_import_documents

    t = tables(spark, sf_dir)
    key = F.col("p_partkey") % 50
    rows = t.raw("part").select(key.alias("k"), F.to_json(F.struct(
        F.col("p_partkey").cast("string").alias("siz_item_id"), F.lit("").alias("size_value"), F.col("p_size").alias("quantity"))).alias("r"))
    body = rows.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("r")), ",").alias("rows"))
    text = F.concat(F.lit('{"rows": ['), F.when(F.col("k") % 10 == 3, F.lit("")).otherwise(F.col("rows")),
                    F.when(F.col("k") % 10 == 7, F.lit("")).otherwise(F.lit("]}")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/bodies-{uuid.uuid4().hex}"
    body.select(text.alias("value"), "k").write.partitionBy("k").text(path)
    read, outcomes = read_import_documents(spark, path, "import_stock")
    found = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"), F.sum("rows").alias("rows"))
    total = read.agg(F.sum(F.col("quantity").cast("long")).alias("quantity"))
    return found.select("outcome", "documents", "rows", F.when(F.col("outcome") == "parsed", total.scalar()).alias("quantity"))


def org_tree_exploded(spark, sf_dir):
    """The nested tree taken apart again: warehouses per spbipk and res unit, departments per res unit."""
    tree = N.org_tree(tables(spark, sf_dir)).select(F.col("id").alias("organization_id"), F.explode("enterprises").alias("e"))
    sp = tree.select("organization_id", F.explode("e.spbipk_list").alias("n")).select(
        "organization_id", F.lit("spbipk").alias("kind"), F.col("n.id").alias("id"), F.size("n.warehouses").alias("warehouses"),
        F.lit(0).alias("departments"))
    ru = tree.select("organization_id", F.explode("e.res_units").alias("n")).select(
        "organization_id", F.lit("res_unit").alias("kind"), F.col("n.id").alias("id"), F.size("n.warehouses").alias("warehouses"),
        F.size("n.departments").alias("departments"))
    return sp.unionByName(ru)


def employee_cards_exploded(spark, sf_dir):
    """Employees with their list of norms, taken apart again."""
    return N.employee_cards(tables(spark, sf_dir)).select(
        F.col("id").alias("employee_id"), "last_name", F.explode_outer("norms").alias("n")).select(
        "employee_id", "last_name", F.col("n.id").alias("norm_id"), F.col("n.quantity").alias("quantity"))


def staff_of_res_warehouses(spark, sf_dir):
    """J9 as pairs for a requested set: the res-unit warehouses whose name ends in 5."""
    t = tables(spark, sf_dir)
    asked = t["warehouses"].where((F.col("warehouse_type") == "res") & F.col("res_unit_id").isNotNull() & F.col("name").endswith("5"))
    return R.warehouse_staff(asked, t).select("warehouse_id", F.col("id").alias("employee_id"), "last_name")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "equipment_cards": equipment_cards,
    "card_stats": card_stats,
    "card_stats_by_enterprise": card_stats_by_enterprise,
    "cards_expiring_soon": cards_expiring_soon,
    "cards_stock_by_type": cards_stock_by_type,
    "cards_expired": cards_expired,
    "cards_issued": cards_issued,
    "cards_search": cards_search,
    "employees_search": employees_search,
    "categories_report": categories_report,
    "items_report": items_report,
    "items_search": items_search,
    "position_norms": position_norms,
    "norm_report": norm_report,
    "entitlements": entitlements,
    "entitlement_counts": entitlement_counts,
    "positions_report": positions_report,
    "enterprises_report": enterprises_report,
    "warehouses_report": warehouses_report,
    "employees_report": employees_report,
    "stock_report": stock_report,
    "stock_totals": stock_totals,
    "holdings_report": holdings_report,
    "movement_report": movement_report,
    "latest_movements": latest_movements,
    "warehouse_staff_counts": warehouse_staff_counts,
    "latest_audit": latest_audit,
    "latest_audit_employees": latest_audit_employees,
    "org_tree_nodes": org_tree_nodes,
    "employee_norm_summary": employee_norm_summary,
    "card_stats_per_actor": card_stats_per_actor,
    "admit_requests": admit_requests,
    "ledger_decisions": ledger_decisions,
    "ledger_stock": ledger_stock,
    "ledger_holdings": ledger_holdings,
    "ledger_movements": ledger_movements,
    "import_stock_deltas": import_stock_deltas,
    "import_stock_summary": import_stock_summary,
    "import_stock_movements": import_stock_movements,
    "retire_ia_warehouses": retire_ia_warehouses,
    "norms_upsert": norms_upsert,
    "stock_upsert_returns": stock_upsert_returns,
    "patch_employees": patch_employees,
    "patch_employees_audit": patch_employees_audit,
    "import_items_rows": import_items_rows,
    "import_items_rejected": import_items_rejected,
    "import_employees_rows": import_employees_rows,
    "check_norm_keys_unique": check_norm_keys_unique,
    "check_movement_employees": check_movement_employees,
    "check_movement_types": check_movement_types,
    "transactions_report": transactions_report,
    "latest_transactions": latest_transactions,
    "insert_employees": insert_employees,
    "import_positions_rows": import_positions_rows,
    "drop_inactive_stock": drop_inactive_stock,
    "adjust_stock": adjust_stock,
    "norms_insert_absent": norms_insert_absent,
    "stream_ledger_stock": stream_ledger_stock,
    "stream_repeats_stock": stream_repeats_stock,
    "ledger_repeats_decisions": ledger_repeats_decisions,
    "ledger_hot_decisions": ledger_hot_decisions,
    "movement_page": movement_page,
    "patch_series": patch_series,
    "patch_series_audit": patch_series_audit,
    "adjust_series": adjust_series,
    "adjust_series_audit": adjust_series_audit,
    "norms_insert_first": norms_insert_first,
    "spbipk_report": spbipk_report,
    "res_units_report": res_units_report,
    "departments_report": departments_report,
    "users_report": users_report,
    "admit_all_operations": admit_all_operations,
    "cards_of_res_actor": cards_of_res_actor,
    "employees_of_res_actor": employees_of_res_actor,
    "warehouses_of_spbipk_actor": warehouses_of_spbipk_actor,
    "transactions_of_res_actor": transactions_of_res_actor,
    "org_tree_of_res_actor": org_tree_of_res_actor,
    "ledger_kinds_decisions": ledger_kinds_decisions,
    "ledger_kinds_stock": ledger_kinds_stock,
    "ledger_kinds_holdings": ledger_kinds_holdings,
    "ledger_kinds_movements": ledger_kinds_movements,
    "ledger_kinds_audit": ledger_kinds_audit,
    "employees_ordered": employees_ordered,
    "items_ordered": items_ordered,
    "cards_ordered": cards_ordered,
    "sizes_in_use": sizes_in_use,
    "seeded_categories": seeded_categories,
    "check_audit_actions": check_audit_actions,
    "import_employees_missing": import_employees_missing,
    "import_positions_repeated": import_positions_repeated,
    "import_stock_unknown_items": import_stock_unknown_items,
    "soft_delete_norms": soft_delete_norms,
    "soft_delete_norms_audit": soft_delete_norms_audit,
    "roles_upsert": roles_upsert,
    "patch_employees_touched": patch_employees_touched,
    "insert_employees_ids": insert_employees_ids,
    "patch_series_hot_audit": patch_series_hot_audit,
    "adjust_series_hot_audit": adjust_series_hot_audit,
    "cards_of_every_actor": cards_of_every_actor,
    "employees_of_every_actor": employees_of_every_actor,
    "cards_by_scope_class": cards_by_scope_class,
    "ledger_latest_audit": ledger_latest_audit,
    "import_stock_written": import_stock_written,
    "import_documents": import_documents,
    "org_tree_exploded": org_tree_exploded,
    "employee_cards_exploded": employee_cards_exploded,
    "staff_of_res_warehouses": staff_of_res_warehouses,
}
