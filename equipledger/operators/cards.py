"""Equipment cards (U1) and card statistics (A2).

One card per stock row with quantity > 0 (source 'warehouse') and per active holding (source 'employee'),
29 columns, UNION ALL. Filters on the result (status, place, scope, search) are pushed by Catalyst into the
branches; a ``source_type`` test removes a whole branch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipledger.functions.scalars import (SOURCE_EMPLOYEE, SOURCE_WAREHOUSE, STATUS_EXPIRED, STATUS_IN_STOCK,
                                           card_status, exploitation_end, typed_null, within_days)
from equipledger.operators.filters import active_holdings, in_stock

CARD_COLUMNS = [
    "id", "source_type", "siz_item_id", "item_name", "item_code", "unit", "exploitation_months",
    "category_name", "size_value", "quantity", "status", "warehouse_id", "warehouse_name", "warehouse_type",
    "enterprise_id", "res_unit_id", "enterprise_fk", "enterprise_name", "res_name", "employee_id", "last_name",
    "first_name", "middle_name", "position_name", "department_name", "department_id", "issued_date",
    "exploitation_start", "exploitation_end",
]


def item_labels(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Item with its category name (item INNER side of the cards, category LEFT)."""
    cat = categories.select(F.col("id").alias("__cat"), F.col("name").alias("category_name"))
    i = items.select(F.col("id").alias("siz_item_id"), F.col("name").alias("item_name"),
                     F.col("code").alias("item_code"), "unit", "exploitation_months", "category_id")
    return i.join(cat, i["category_id"] == cat["__cat"], "left").drop("__cat", "category_id")


def warehouse_enterprise(warehouses: DataFrame, enterprises: DataFrame, spbipk: DataFrame) -> DataFrame:
    """The warehouse's enterprise, directly or else through its spbipk (``enterprise_fk``, name)."""
    ent_w = enterprises.select(F.col("id").alias("__ew"), F.col("name").alias("__ew_name"))
    sp = spbipk.select(F.col("id").alias("__sp"), F.col("enterprise_id").alias("__sp_ent"))
    ent_sp = enterprises.select(F.col("id").alias("__es"), F.col("name").alias("__es_name"))
    w = (warehouses
         .join(ent_w, warehouses["enterprise_id"] == ent_w["__ew"], "left")
         .join(sp, warehouses["spbipk_id"] == sp["__sp"], "left"))
    w = w.join(ent_sp, w["__sp_ent"] == ent_sp["__es"], "left")
    return (w.withColumn("enterprise_fk", F.coalesce("__ew", "__es"))
             .withColumn("enterprise_name", F.coalesce("__ew_name", "__es_name"))
             .drop("__ew", "__ew_name", "__sp", "__sp_ent", "__es", "__es_name"))


def stock_cards(t: Mapping[str, DataFrame]) -> DataFrame:
    """Branch (a): stock rows with quantity > 0; item and warehouse INNER, the rest LEFT."""
    ws = in_stock(t["warehouse_stock"]).select(
        F.col("id").cast("string").alias("id"), "siz_item_id", "size_value", "quantity", "warehouse_id")
    items = item_labels(t["siz_items"], t["siz_categories"])
    wh = warehouse_enterprise(
        t["warehouses"].select("id", "name", "warehouse_type", "enterprise_id", "res_unit_id", "spbipk_id"),
        t["enterprises"], t["spbipk"])
    res = t["res_units"].select(F.col("id").alias("__r"), F.col("name").alias("res_name"))
    wh = (wh.join(res, wh["res_unit_id"] == res["__r"], "left")
          .select(F.col("id").alias("warehouse_id"), F.col("name").alias("warehouse_name"), "warehouse_type",
                  "enterprise_id", "res_unit_id", "enterprise_fk", "enterprise_name", "res_name"))
    j = ws.join(items, "siz_item_id").join(wh, "warehouse_id")
    return j.select(
        "id", F.lit(SOURCE_WAREHOUSE).alias("source_type"), "siz_item_id", "item_name", "item_code", "unit",
        "exploitation_months", "category_name", "size_value", "quantity", F.lit(STATUS_IN_STOCK).alias("status"),
        "warehouse_id", "warehouse_name", "warehouse_type", "enterprise_id", "res_unit_id", "enterprise_fk",
        "enterprise_name", "res_name", typed_null("string").alias("employee_id"),
        typed_null("string").alias("last_name"), typed_null("string").alias("first_name"),
        typed_null("string").alias("middle_name"), typed_null("string").alias("position_name"),
        typed_null("string").alias("department_name"), typed_null("string").alias("department_id"),
        typed_null("date").alias("issued_date"), typed_null("date").alias("exploitation_start"),
        typed_null("date").alias("exploitation_end"))


def employee_labels(t: Mapping[str, DataFrame]) -> DataFrame:
    """Employee with enterprise, res unit, department and position names (all LEFT)."""
    e = t["employees"].select(F.col("id").alias("employee_id"), "last_name", "first_name", "middle_name",
                              "enterprise_id", "res_unit_id", "department_id", "position_id")
    ent = t["enterprises"].select(F.col("id").alias("__e"), F.col("id").alias("enterprise_fk"),
               F.col("name").alias("enterprise_name"))
    res = t["res_units"].select(F.col("id").alias("__r"), F.col("name").alias("res_name"))
    dep = t["departments"].select(F.col("id").alias("__d"), F.col("name").alias("department_name"))
    pos = t["positions"].select(F.col("id").alias("__p"), F.col("name").alias("position_name"))
    e = (e.join(ent, e["enterprise_id"] == ent["__e"], "left")
          .join(res, e["res_unit_id"] == res["__r"], "left")
          .join(dep, e["department_id"] == dep["__d"], "left")
          .join(pos, e["position_id"] == pos["__p"], "left"))
    return e.drop("__e", "__r", "__d", "__p", "position_id")


def holding_cards(t: Mapping[str, DataFrame], as_of=None) -> DataFrame:
    """Branch (b): active holdings; item and employee INNER, the rest LEFT; expiry status against ``as_of``."""
    h = active_holdings(t["employee_siz"]).select(
        F.col("id").cast("string").alias("id"), "siz_item_id", "size_value", "quantity", "exploitation_start",
        "issued_date", "employee_id", F.col("from_warehouse_id"))
    items = item_labels(t["siz_items"], t["siz_categories"])
    wf = t["warehouses"].select(F.col("id").alias("__wf"), F.col("id").alias("warehouse_id"),
              F.col("name").alias("warehouse_name"), "warehouse_type")
    emp = employee_labels(t)
    j = (h.join(items, "siz_item_id")
          .join(emp, "employee_id")
          .join(wf, h["from_warehouse_id"] == wf["__wf"], "left"))
    end = exploitation_end("exploitation_start", "exploitation_months")
    j = j.withColumn("exploitation_end", end)
    return j.select(
        "id", F.lit(SOURCE_EMPLOYEE).alias("source_type"), "siz_item_id", "item_name", "item_code", "unit",
        "exploitation_months", "category_name", "size_value", "quantity",
        card_status(F.col("exploitation_end"), as_of).alias("status"),
        "warehouse_id", "warehouse_name", "warehouse_type", "enterprise_id", "res_unit_id", "enterprise_fk",
        "enterprise_name", "res_name", "employee_id", "last_name", "first_name", "middle_name", "position_name",
        "department_name", "department_id", "issued_date", "exploitation_start", "exploitation_end")


def equipment_cards(t: Mapping[str, DataFrame], as_of=None) -> DataFrame:
    """The card view, both branches, by position (same 29 columns in both)."""
    return stock_cards(t).unionByName(holding_cards(t, as_of))


def card_core(t: Mapping[str, DataFrame], as_of=None) -> DataFrame:
    """What counting and scoping need of every card: source, status, end and the two scope columns. Only the INNER
    sides of the card view are joined (they decide which cards exist); no label is."""
    items = t["siz_items"].select(F.col("id").alias("siz_item_id"), "exploitation_months")
    scope = ["enterprise_id", "res_unit_id"]
    stock = (in_stock(t["warehouse_stock"]).select("siz_item_id", "warehouse_id")
             .join(items.select("siz_item_id"), "siz_item_id")
             .join(t["warehouses"].select(F.col("id").alias("warehouse_id"), *scope), "warehouse_id")
             .select(F.lit(SOURCE_WAREHOUSE).alias("source_type"), F.lit(STATUS_IN_STOCK).alias("status"),
                     typed_null("date").alias("exploitation_end"), *scope))
    end = exploitation_end("exploitation_start", "exploitation_months")
    held = (active_holdings(t["employee_siz"]).select("siz_item_id", "employee_id", "exploitation_start")
            .join(items, "siz_item_id")
            .join(t["employees"].select(F.col("id").alias("employee_id"), *scope), "employee_id")
            .select(F.lit(SOURCE_EMPLOYEE).alias("source_type"), card_status(end, as_of).alias("status"),
                    end.alias("exploitation_end"), *scope))
    return stock.unionByName(held)


def card_stats_aggs(as_of=None) -> list:
    """The five A2 counters as aggregate expressions (row counts, not quantities)."""
    src, st = F.col("source_type"), F.col("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(src == SOURCE_WAREHOUSE).alias("in_stock"),
        F.count_if((src == SOURCE_EMPLOYEE) & (st == "issued")).alias("issued"),
        F.count_if(st == STATUS_EXPIRED).alias("expired"),
        F.count_if((src == SOURCE_EMPLOYEE) & F.coalesce(within_days(F.col("exploitation_end"), as_of),
                                                          F.lit(False))).alias("expiring_soon"),
    ]


STAT_COLUMNS = ["total", "in_stock", "issued", "expired", "expiring_soon"]


def card_stats(cards: DataFrame, as_of=None, by: list[str] | None = None) -> DataFrame:
    """A2: total / in_stock / issued / expired / expiring_soon row counts in one pass (partial + final
    aggregate). ``by`` gives the same per group (e.g. per enterprise: every enterprise actor at once)."""
    cards = cards.select("source_type", "status", "exploitation_end", *(by or []))
    aggs = card_stats_aggs(as_of)
    return cards.groupBy(*by).agg(*aggs) if by else cards.agg(*aggs)


def card_stats_by_scope(cards: DataFrame, as_of=None) -> DataFrame:
    """A2 for every scope key at once, in ONE aggregate over the cards (grouping sets): per enterprise_id
    (scope_kind 'enterprise'), per res_unit_id ('res') and the grand total ('total', scope_key '*')."""
    c = cards.select("source_type", "status", "exploitation_end", "enterprise_id", "res_unit_id")
    g = c.groupingSets([["enterprise_id"], ["res_unit_id"], []], "enterprise_id", "res_unit_id").agg(
        *card_stats_aggs(as_of), F.grouping_id().alias("__gid"))
    kind = F.when(F.col("__gid") == 1, "enterprise").when(F.col("__gid") == 2, "res").otherwise("total")
    key = (F.when(F.col("__gid") == 1, F.col("enterprise_id")).when(F.col("__gid") == 2, F.col("res_unit_id"))
            .otherwise(F.lit("*")))
    return g.select(kind.alias("scope_kind"), key.alias("scope_key"), *STAT_COLUMNS)
