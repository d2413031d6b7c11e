"""Reports: labelled joins (J1-J10, J12), child counts (A1), stock totals (A3), ordering and top-k.

Each report answers for the whole table at once (the original answered one id per request); a per-id
answer is a filter on the result, which Catalyst pushes to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from equipledger.functions.scalars import exploitation_end
from equipledger.operators.filters import (active_holdings, active_only, by_warehouse, filter_equal, in_stock,
                                           search)
from equipledger.plans.joins import dealt, left_labels, null_safe_left
from equipledger.schemas import SCHEMAS
from equipledger.sources.tables import read_ledger


# ---------------------------------------------------------------- ordering (O1, O2)

# What the original's lists are ordered by (fixed values); text by the rules of its language.
REPORT_ORDER = {
    "categories": ["name"], "items": ["category_name", "name"], "norms": ["category_name", "item_name"],
    "norm_report": ["position_name", "category_name", "item_name"], "sizes": ["category_type", "sort_order"],
    "warehouses": ["warehouse_type", "name"], "stock": ["category_name", "item_name", "gender", "size_value"],
    "cards": ["category_name", "item_name", "size_value"], "employees": ["last_name", "first_name"]}
TEXT_ORDER = "ru"


def order_report(df: DataFrame, cols: list[str], desc: bool = False, locale: str | None = None) -> DataFrame:
    """O1: multi-key ascending with NULLs last (PostgreSQL order); O2 with ``desc``: NULLs first. ``locale`` orders text by
    that language (Russian: ё beside е, small before capital letters of one spelling) instead of by code point."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)} if locale else set()
    keys = [F.collate(F.col(c), locale) if c in text else F.col(c) for c in cols]
    return df.orderBy(*[k.desc_nulls_first() if desc else k.asc_nulls_last() for k in keys])


def in_report_order(df: DataFrame, report: str, limit: int | None = None, tie_break: str | None = None) -> DataFrame:
    """O1 for one of the original's lists, optionally its first ``limit`` rows (planned as TakeOrderedAndProject; without a
    limit a range sort, so ask for it where rows are shown). ``tie_break`` makes the limit repeatable."""
    out = order_report(df, REPORT_ORDER[report] + ([tie_break] if tie_break else []), locale=TEXT_ORDER)
    return out.limit(limit) if limit is not None else out


def latest_first(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """O2: newest first by the given date columns, optional LIMIT (planned as TakeOrderedAndProject)."""
    out = order_report(df, cols, desc=True)
    return out.limit(limit) if limit is not None else out


# ---------------------------------------------------------------- catalogue

def count_children(parent: DataFrame, child: DataFrame, fk: str, alias: str, child_filter: Column | None = None,
                   key: str = "id") -> DataFrame:
    """A1: correlated COUNT(*) per parent, 0 when none: pre-aggregate the child (partial + final), LEFT join."""
    c = child.where(child_filter) if child_filter is not None else child
    counts = c.groupBy(F.col(fk).alias("__pk")).agg(F.count(F.lit(1)).alias(alias))
    j = parent.join(counts, parent[key] == counts["__pk"], "left").drop("__pk")
    return j.withColumn(alias, F.coalesce(F.col(alias), F.lit(0)))


def categories_report(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Active categories with their number of active items."""
    return count_children(active_only(categories), items, "category_id", "items_count", F.col("is_active"))


def items_report(items: DataFrame, categories: DataFrame, category_id: str | None = None,
                 text: str | None = None) -> DataFrame:
    """J1 + F2 + F3: active items with category name / code; search in name and code."""
    i = filter_equal(active_only(items), {"category_id": category_id})
    i = search(i, text, ["name", "code"])
    return left_labels(i, categories, "category_id", cols={"name": "category_name", "code": "category_code"})


def _item_cols(items: DataFrame, categories: DataFrame, cols: dict[str, str], only_active: bool = False
               ) -> DataFrame:
    """Item projected to ``{col: alias}`` plus its category name (LEFT)."""
    i = active_only(items) if only_active else items
    i = i.select(F.col("id").alias("__i"), "category_id", *[F.col(c).alias(a) for c, a in cols.items()])
    return left_labels(i, categories, "category_id", cols={"name": "category_name"})


def position_norms(norms: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Active norms INNER item (item activity not required) LEFT category, for every position."""
    n = active_only(norms)
    i = _item_cols(items, categories, {"name": "item_name", "unit": "unit",
                                       "wear_period_months": "wear_period_months"})
    return n.join(i, n["siz_item_id"] == i["__i"]).drop("__i", "category_id")


def norm_report(norms: DataFrame, positions: DataFrame, items: DataFrame, categories: DataFrame,
                position_id: str | None = None, category_id: str | None = None) -> DataFrame:
    """Norm, position and item all active; category LEFT; optional position / category filters."""
    n = filter_equal(active_only(norms), {"position_id": position_id}).select(
        "id", "position_id", "siz_item_id", "quantity", "issue_period_months")
    p = active_only(positions).select(F.col("id").alias("__p"), F.col("name").alias("position_name"),
                                      F.col("code").alias("position_code"), "enterprise_id", "res_unit_id",
                                      "department_id")
    i = active_only(items)
    if category_id:
        i = i.where(F.col("category_id") == category_id)
    i = _item_cols(i, categories, {"name": "item_name", "code": "item_code", "unit": "unit",
                                   "wear_period_months": "wear_period_months",
                                   "exploitation_months": "exploitation_months",
                                   "exploitation_years": "exploitation_years"})
    j = (n.join(p, n["position_id"] == p["__p"])
          .join(i, n["siz_item_id"] == i["__i"]))
    return j.drop("__p", "__i", "category_id")


def entitlements(employees: DataFrame, norms: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Every employee's entitlement: employee x active norm of its position x active item.

    Employee and position activity are not required. ``position_id`` is a low-cardinality, hot key (a
    position may hold a third of all employees) and the result is far larger than both sides: a position is cut
    into parts by the rows that it makes (``joins.dealt``).
    """
    n = active_only(norms).select(F.col("position_id"), F.col("siz_item_id"), F.col("quantity").alias("norm_quantity"),
                                  "issue_period_months")
    i = _item_cols(items, categories, {"name": "name", "code": "code", "unit": "unit",
                                       "wear_period_months": "wear_period_months"}, only_active=True)
    ni = (n.join(i, n["siz_item_id"] == i["__i"])
           .select(F.col("position_id").alias("__pos"), F.col("__i").alias("id"), "name", "code", "unit",
                   "wear_period_months", "category_name", "norm_quantity", "issue_period_months"))
    e = employees.select(F.col("id").alias("employee_id"), F.col("position_id").alias("__pos"))
    e, ni = dealt(e, ni, "__pos", "employee_id")
    return e.join(ni, ["__pos", "__part"]).drop("__pos", "__part")


def entitlement_counts(employees: DataFrame, norms: DataFrame, items: DataFrame) -> DataFrame:
    """Per employee: number of entitled items and total entitled quantity, without materialising the pairs
    (norms are aggregated per position first, then joined once per employee)."""
    n = active_only(norms)
    i = active_only(items).select(F.col("id").alias("siz_item_id"))
    per_pos = (n.join(i, "siz_item_id").groupBy("position_id")
                .agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").cast("bigint").alias("total_quantity")))
    e = employees.select(F.col("id").alias("employee_id"), "position_id")
    j = e.join(per_pos, "position_id", "left")
    return j.select("employee_id", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"),
                    F.coalesce("total_quantity", F.lit(0)).cast("bigint").alias("total_quantity"))


# ---------------------------------------------------------------- organisation

def positions_report(positions: DataFrame, norms: DataFrame, employees: DataFrame, enterprises: DataFrame,
                     res_units: DataFrame, departments: DataFrame, filters: dict | None = None) -> DataFrame:
    """J1 + A1: active positions with enterprise / res / department names, active norm and employee counts."""
    p = filter_equal(active_only(positions), filters)
    p = count_children(p, norms, "position_id", "norms_count", F.col("is_active"))
    p = count_children(p, employees, "position_id", "employees_count", F.col("is_active"))
    p = left_labels(p, enterprises, "enterprise_id", cols={"name": "enterprise_name"})
    p = left_labels(p, res_units, "res_unit_id", cols={"name": "res_name"})
    return left_labels(p, departments, "department_id", cols={"name": "department_name"})


def enterprises_report(enterprises: DataFrame, organizations: DataFrame) -> DataFrame:
    return left_labels(active_only(enterprises), organizations, "organization_id",
                       cols={"name": "organization_name"})


def spbipk_report(spbipk: DataFrame, enterprises: DataFrame, filters: dict | None = None) -> DataFrame:
    s = filter_equal(active_only(spbipk), filters)
    return left_labels(s, enterprises, "enterprise_id", cols={"name": "enterprise_name"})


def res_units_report(res_units: DataFrame, enterprises: DataFrame, spbipk: DataFrame,
                     filters: dict | None = None) -> DataFrame:
    r = filter_equal(active_only(res_units), filters)
    r = left_labels(r, enterprises, "enterprise_id", cols={"name": "enterprise_name"})
    return left_labels(r, spbipk, "spbipk_id", cols={"name": "spbipk_name"})


def departments_report(departments: DataFrame, res_units: DataFrame, filters: dict | None = None) -> DataFrame:
    d = filter_equal(active_only(departments), filters)
    return left_labels(d, res_units, "res_unit_id", cols={"name": "res_name"})


def users_report(t: Mapping[str, DataFrame]) -> DataFrame:
    """Every user (active or not) with role, organisation, enterprise and res unit names."""
    u = left_labels(t["users"], t["roles"], "role_id", cols={"display_name": "role_name", "level": "role_level"})
    u = left_labels(u, t["organizations"], "organization_id", cols={"name": "organization_name"})
    u = left_labels(u, t["enterprises"], "enterprise_id", cols={"name": "enterprise_name"})
    return left_labels(u, t["res_units"], "res_unit_id", cols={"name": "res_name"})


def warehouses_report(warehouses: DataFrame, spbipk: DataFrame, res_units: DataFrame, enterprises: DataFrame,
                      filters: dict | None = None) -> DataFrame:
    """Active warehouses with spbipk / res / enterprise names; filters on type and the three org ids."""
    w = filter_equal(active_only(warehouses), filters)
    w = left_labels(w, spbipk, "spbipk_id", cols={"name": "spbipk_name"})
    w = left_labels(w, res_units, "res_unit_id", cols={"name": "res_name"})
    return left_labels(w, enterprises, "enterprise_id", cols={"name": "enterprise_name"})


def employees_report(t: Mapping[str, DataFrame], filters: dict | None = None, text: str | None = None
                     ) -> DataFrame:
    """J1 + F2 + F3: active employees with position / res / enterprise / department names."""
    e = filter_equal(active_only(t["employees"]), filters)
    e = search(e, text, ["last_name", "first_name", "employee_number"])
    e = left_labels(e, t["positions"], "position_id", cols={"name": "position_name"})
    e = left_labels(e, t["res_units"], "res_unit_id", cols={"name": "res_name"})
    e = left_labels(e, t["enterprises"], "enterprise_id", cols={"name": "enterprise_name"})
    return left_labels(e, t["departments"], "department_id", cols={"name": "department_name"})


# ---------------------------------------------------------------- stock, holdings, movements

def stock_report(stock: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """Stock rows with quantity > 0, INNER item, LEFT category; every warehouse at once."""
    ws = in_stock(stock).select("id", "warehouse_id", "siz_item_id", "size_value", "quantity")
    i = items.select(F.col("id").alias("__i"), "category_id", F.col("name").alias("item_name"),
                     F.col("code").alias("item_code"), "unit", F.col("gender").alias("item_gender"), "season",
                     "exploitation_months", "exploitation_years")
    i = left_labels(i, categories, "category_id", cols={"name": "category_name", "code": "category_code"})
    return ws.join(i, ws["siz_item_id"] == i["__i"]).drop("__i", "category_id")


def stock_totals(warehouses: DataFrame, stock: DataFrame) -> DataFrame:
    """A3: SUM(quantity) per warehouse, 0 when it has no stock rows."""
    s = stock.groupBy(F.col("warehouse_id").alias("__w")).agg(F.sum("quantity").cast("bigint").alias("total"))
    w = warehouses.select("id")
    j = w.join(s, w["id"] == s["__w"], "left")
    return j.select(F.col("id").alias("warehouse_id"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def holdings_report(holdings: DataFrame, items: DataFrame, categories: DataFrame, warehouses: DataFrame
                    ) -> DataFrame:
    """Active holdings INNER item, LEFT category and issuing warehouse, with ``exploitation_end``."""
    h = active_holdings(holdings)
    i = items.select(F.col("id").alias("__i"), "category_id", F.col("name").alias("item_name"),
                     F.col("code").alias("item_code"), "unit", "exploitation_months", "exploitation_years",
                     F.col("gender").alias("item_gender"), "season")
    i = left_labels(i, categories, "category_id", cols={"name": "category_name"})
    j = h.join(i, h["siz_item_id"] == i["__i"]).drop("__i", "category_id")
    j = left_labels(j, warehouses, "from_warehouse_id", cols={"name": "warehouse_name"})
    return j.withColumn("exploitation_end", exploitation_end("exploitation_start", "exploitation_months"))


def movement_report(t: Mapping[str, DataFrame], moves: DataFrame | None = None) -> DataFrame:
    """Movements INNER item; LEFT category, from / to warehouse (one table in two roles), employee, user."""
    m = t["stock_movements"] if moves is None else moves
    # movements that name no user need no join: they are not shuffled for it
    m = m.where(F.col("moved_by").isNull()).withColumn("moved_by_name", F.lit(None).cast("string")).unionByName(
        left_labels(m.where(F.col("moved_by").isNotNull()), t["users"], "moved_by", cols={"full_name": "moved_by_name"}))
    i = t["siz_items"].select(F.col("id").alias("__i"), "category_id", F.col("name").alias("item_name"),
                              F.col("unit").alias("unit"))
    i = left_labels(i, t["siz_categories"], "category_id", cols={"name": "category_name"})
    j = m.join(i, m["siz_item_id"] == i["__i"]).drop("__i", "category_id")
    j = left_labels(j, t["warehouses"], "from_warehouse_id", cols={"name": "from_warehouse_name"})
    j = left_labels(j, t["warehouses"], "to_warehouse_id", cols={"name": "to_warehouse_name"})
    e = t["employees"].select(F.col("id").alias("__e"), "last_name", "first_name", "middle_name")
    return null_safe_left(j, e, "employee_id", "__e").drop("__e")


def latest_movements(moves: DataFrame, n: int = 200) -> DataFrame:
    """O3: per warehouse, its newest ``n`` movements (from or to it), newest first by (created_at, id).

    ``row_number() <= n`` over a window is planned with a map-side ``WindowGroupLimit`` before the shuffle
    (Spark's window group limit), so every input partition sends at most ``n`` rows per warehouse: a hot
    warehouse costs at most ``n`` x partitions rows in its final task, never its whole history.
    """
    m = by_warehouse(moves, "warehouse_id_")
    w = Window.partitionBy("warehouse_id_").orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())
    out = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.withColumnRenamed("warehouse_id_", "warehouse_id")


def movement_page(t: Mapping[str, DataFrame], n: int = 200) -> DataFrame:
    """O3 + J5: per warehouse its newest ``n`` movements with item, category, both warehouses, employee and user
    labels. The labels are joined to the chosen rows only."""
    return movement_report(t, latest_movements(t["stock_movements"], n))


def transaction_report(t: Mapping[str, DataFrame], employee_id: str | None = None, limit: int | None = None,
                       tie_break: str | None = None, ordered: bool = False) -> DataFrame:
    """J10 + O2: old transaction feed INNER employee and item, LEFT category and user.

    With ``limit`` the newest rows, newest first: rows whose employee and item exist are cut to the top first, and the labels are
    attached to these. The whole feed is sorted only if ``ordered`` asks for it."""
    tx = filter_equal(t["siz_transactions"], {"employee_id": employee_id})
    newest = ["transaction_date", "created_at"] + ([tie_break] if tie_break else [])
    if limit is not None:
        for fk, parent in (("employee_id", "employees"), ("siz_item_id", "siz_items")):
            tx = tx.join(t[parent].select(F.col("id").alias(fk)), fk, "left_semi")
        tx = latest_first(tx, newest, limit)
    e = t["employees"].select(F.col("id").alias("__e"), "last_name", "first_name", "middle_name",
                              "employee_number", F.col("enterprise_id").alias("employee_enterprise_id"),
                              F.col("res_unit_id").alias("employee_res_unit_id"))
    j = tx.join(e, tx["employee_id"] == e["__e"]).drop("__e")
    i = t["siz_items"].select(F.col("id").alias("__i"), "category_id", F.col("name").alias("item_name"), "unit")
    i = left_labels(i, t["siz_categories"], "category_id", cols={"name": "category_name"})
    j = j.join(i, j["siz_item_id"] == i["__i"]).drop("__i", "category_id")
    j = left_labels(j, t["users"], "issued_by", cols={"full_name": "issued_by_name"})
    return latest_first(j, newest) if limit is not None or ordered else j


def audit_report(audit: DataFrame, users: DataFrame, table_name: str | None = None, n: int = 100) -> DataFrame:
    """J12 + O4 (= D3): newest ``n`` audit rows with user name / username, optional table filter."""
    a = filter_equal(audit, {"table_name": table_name})
    top = a.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(n)
    return audit_labels(top, users)


def audit_labels(top: DataFrame, users: DataFrame) -> DataFrame:
    return left_labels(top, users, "user_id", cols={"full_name": "user_name", "username": "username"})


def latest_of_ledger(spark: SparkSession, root: str, table: str, n: int = 100, filters: dict | None = None) -> DataFrame:
    """O4 over an appended ledger (S4): the newest ``n`` rows, from as few months as hold them.

    The months are partition folders, known from the file names. They are counted newest first, one more than twice as many at a
    time, until ``n`` rows are found; only their folders are read then. Rows without a time come first (NULLS FIRST), so their
    folder is always read."""
    ledger = read_ledger(spark, root, table)
    files = ledger.inputFiles()
    months = sorted({m[1] for m in (re.search("/month=([^/]+)/", f) for f in files) if m}, reverse=True)
    dated = [m for m in months if re.fullmatch(r"\d{4,}-\d\d", m)]
    found, rows, step = 0, filter_equal(ledger, filters), 1
    newest = F.col("month").isNull()
    for at in range(0, len(dated)):
        if at + 1 < step and at + 1 < len(dated):
            continue
        newest = F.col("month").isNull() | (F.col("month") >= dated[at])
        found = rows.where(newest).limit(n).count()
        if found >= n:
            break
        step = 2 * step + 1
    top = rows.where(newest).orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(n)
    return top.select(*SCHEMAS[table].fieldNames())


# ---------------------------------------------------------------- warehouse staff

STAFF_RES, STAFF_ENTERPRISE, STAFF_CENTRAL, STAFF_ALL = "res", "enterprise", "central", "all"


def warehouse_staff_keys(warehouses: DataFrame) -> DataFrame:
    """Classify each warehouse once by the first matching staff rule into an equi-join key (kind, value):
    res unit set -> (res, res_unit_id); spbipk set -> (enterprise, enterprise_id); type 'ia' -> (central, '');
    enterprise set -> (enterprise, enterprise_id); else (all, '')."""
    kind = (F.when(F.col("res_unit_id").isNotNull(), STAFF_RES)
             .when(F.col("spbipk_id").isNotNull(), STAFF_ENTERPRISE)
             .when(F.col("warehouse_type") == "ia", STAFF_CENTRAL)
             .when(F.col("enterprise_id").isNotNull(), STAFF_ENTERPRISE)
             .otherwise(STAFF_ALL))
    value = (F.when(F.col("res_unit_id").isNotNull(), F.col("res_unit_id"))
              .when(F.col("spbipk_id").isNotNull(), F.coalesce(F.col("enterprise_id"), F.lit("\u0000null")))
              .when(F.col("warehouse_type") == "ia", F.lit(""))
              .when(F.col("enterprise_id").isNotNull(), F.col("enterprise_id"))
              .otherwise(F.lit("")))
    return warehouses.select(F.col("id").alias("warehouse_id"), kind.alias("staff_kind"), value.alias("staff_key"))


def employee_staff_keys(employees: DataFrame) -> DataFrame:
    """Every staff key an active employee answers to (at most three): its res unit; its enterprise when it has
    no res unit; central when it has no enterprise; and 'all'."""
    e = active_only(employees)
    keys = F.array(
        F.when(F.col("res_unit_id").isNotNull(), F.struct(F.lit(STAFF_RES).alias("k"), F.col("res_unit_id").alias("v"))),
        F.when(F.col("res_unit_id").isNull() & F.col("enterprise_id").isNotNull(),
               F.struct(F.lit(STAFF_ENTERPRISE).alias("k"), F.col("enterprise_id").alias("v"))),
        F.when(F.col("enterprise_id").isNull(), F.struct(F.lit(STAFF_CENTRAL).alias("k"), F.lit("").alias("v"))),
        F.struct(F.lit(STAFF_ALL).alias("k"), F.lit("").alias("v")),
    )
    x = e.select(F.col("id").alias("employee_id"), F.explode(F.filter(keys, lambda s: s.isNotNull())).alias("s"))
    return x.select("employee_id", F.col("s.k").alias("staff_kind"), F.col("s.v").alias("staff_key"))


def warehouse_staff(warehouses: DataFrame, t: Mapping[str, DataFrame]) -> DataFrame:
    """The staff list of each requested warehouse (the warehouse may be inactive) with employee labels.

    An equi-join on the classified (kind, key) -- never an OR condition (which plans as a nested loop). The
    requested warehouses are the small side; the 'all' / 'central' keys are hot on the employee side: the
    warehouse side is broadcast below the threshold in bytes, and beyond it AQE splits the hot partitions.
    """
    wk = warehouse_staff_keys(warehouses)
    ek = employee_staff_keys(t["employees"])
    pairs = ek.join(wk, ["staff_kind", "staff_key"])
    e = employees_report(t)
    return pairs.join(e, pairs["employee_id"] == e["id"]).drop("staff_kind", "staff_key")


def warehouse_staff_counts(warehouses: DataFrame, employees: DataFrame) -> DataFrame:
    """J9 as counts for every warehouse: staff per key aggregated once, then one small join; no pairs."""
    per_key = employee_staff_keys(employees).groupBy("staff_kind", "staff_key").agg(
        F.count(F.lit(1)).alias("staff_count"))
    wk = warehouse_staff_keys(warehouses)
    j = wk.join(per_key, ["staff_kind", "staff_key"], "left")
    return j.select("warehouse_id", "staff_kind", F.coalesce("staff_count", F.lit(0)).cast("bigint").alias("staff_count"))


def item_exists(rows: DataFrame, items: DataFrame, fk: str = "siz_item_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose item is active, rows whose item is missing or inactive) by semi / anti join."""
    act = active_only(items).select(F.col("id").alias(fk))
    return rows.join(act, fk, "left_semi"), rows.join(act, fk, "left_anti")
