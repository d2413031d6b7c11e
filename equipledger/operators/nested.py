"""Nested results: organisation tree (N1) and employee card with norms.

Lists are built bottom-up, one ``groupBy(parent).agg(collect_list(struct))`` per level, then LEFT joined to
the parent with ``coalesce(list, array())``. Each list holds the direct children of ONE org unit (its
warehouses, departments, spbipk, res units, enterprises), so a list is one output value and its size is
bounded by the organisation's structure, not by the ledger. The flattened forms (``org_tree_nodes``,
``employee_norm_summary``) answer the same questions with no collect at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipledger.operators.filters import active_only
from equipledger.operators.scope import tree_scope
from equipledger.plans.joins import dealt


def _children(child: DataFrame, fk: str, alias: str) -> DataFrame:
    """``fk -> sorted array of child structs`` (array sorted by the struct, so the result is deterministic)."""
    cols = [c for c in child.columns]
    return (child.where(F.col(fk).isNotNull())
            .groupBy(F.col(fk).alias("__parent"))
            .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(alias)))


def _attach(parent: DataFrame, lists: DataFrame, alias: str, key: str = "id") -> DataFrame:
    j = parent.join(lists, parent[key] == lists["__parent"], "left").drop("__parent")
    return j.withColumn(alias, F.coalesce(F.col(alias), F.array().cast(lists.schema[alias].dataType)))


def org_tree(t: Mapping[str, DataFrame], actor: Mapping | None = None) -> DataFrame:
    """One row per active organisation with ``warehouses`` (central 'ia' warehouses without enterprise,
    the same list under every organisation) and ``enterprises[]`` -> ``spbipk_list[]`` (with warehouses) and
    ``res_units[]`` (with warehouses and departments)."""
    s = tree_scope({k: active_only(t[k]) for k in ("enterprises", "spbipk", "res_units")}, actor)
    whs = active_only(t["warehouses"])
    depts = active_only(t["departments"])

    sp = _attach(s["spbipk"], _children(whs, "spbipk_id", "warehouses"), "warehouses")
    ru = _attach(s["res_units"], _children(whs, "res_unit_id", "warehouses"), "warehouses")
    ru = _attach(ru, _children(depts, "res_unit_id", "departments"), "departments")
    ent = _attach(s["enterprises"], _children(sp, "enterprise_id", "spbipk_list"), "spbipk_list")
    ent = _attach(ent, _children(ru, "enterprise_id", "res_units"), "res_units")
    orgs = active_only(t["organizations"])
    orgs = _attach(orgs, _children(ent, "organization_id", "enterprises"), "enterprises")

    central = whs.where((F.col("warehouse_type") == "ia") & F.col("enterprise_id").isNull())
    central_list = central.agg(F.sort_array(F.collect_list(F.struct(*central.columns))).alias("warehouses"))
    # a scalar subquery: the list is one value, which every organisation shows
    return orgs.withColumn("warehouses", central_list.scalar())


def org_tree_nodes(t: Mapping[str, DataFrame], actor: Mapping | None = None) -> DataFrame:
    """N1 flattened: one row per tree node (node_type, node_id, parent_type, parent_id), exactly the nodes the
    nested tree lists. Central warehouses, which the tree repeats under every organisation, appear once with
    parent_type 'all_organizations' (no organisation x warehouse product)."""
    s = tree_scope({k: active_only(t[k]) for k in ("enterprises", "spbipk", "res_units")}, actor)
    whs = active_only(t["warehouses"])
    depts = active_only(t["departments"])
    orgs = active_only(t["organizations"])

    def node(df, ntype, ptype, pcol):
        parent = F.col(pcol) if pcol else F.lit(None).cast("string")
        return df.select(F.lit(ntype).alias("node_type"), F.col("id").alias("node_id"),
                         F.lit(ptype).cast("string").alias("parent_type"), parent.alias("parent_id"))

    def under(child, fk, parent):
        return child.join(parent.select(F.col("id").alias(fk)), fk, "left_semi")

    ents = under(s["enterprises"], "organization_id", orgs)
    sps = under(s["spbipk"], "enterprise_id", ents)
    rus = under(s["res_units"], "enterprise_id", ents)
    central = whs.where((F.col("warehouse_type") == "ia") & F.col("enterprise_id").isNull())
    parts = [
        node(orgs, "organization", None, None),
        node(central, "warehouse", "all_organizations", None),
        node(ents, "enterprise", "organization", "organization_id"),
        node(sps, "spbipk", "enterprise", "enterprise_id"),
        node(rus, "res_unit", "enterprise", "enterprise_id"),
        node(under(whs, "spbipk_id", sps), "warehouse", "spbipk", "spbipk_id"),
        node(under(whs, "res_unit_id", rus), "warehouse", "res_unit", "res_unit_id"),
        node(under(depts, "res_unit_id", rus), "department", "res_unit", "res_unit_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def employee_cards(t: Mapping[str, DataFrame]) -> DataFrame:
    """Every employee (any activity) with position / res / enterprise / department names and ``norms[]``:
    the active norms of its position with item name, unit and category name (item activity not required).

    The norm list is built once per position and joined to the employees; a position is cut into parts by the norms that its
    employees list in all (``joins.dealt``)."""
    from equipledger.operators.reports import employees_report, position_norms

    pn = position_norms(t["position_siz_norms"], t["siz_items"], t["siz_categories"])
    lists = _children(pn, "position_id", "norms")
    e = employees_report({**t, "employees": t["employees"].withColumn("is_active", F.lit(True))})
    e = e.drop("is_active").join(t["employees"].select("id", "is_active"), "id")
    e, lists = dealt(e, lists.withColumnRenamed("__parent", "position_id"), "position_id", "id", F.size("norms"))
    lists = lists.withColumnRenamed("position_id", "__parent")
    j = e.join(lists, (e["position_id"] == lists["__parent"]) & (e["__part"] == lists["__part"]), "left").drop("__parent", lists["__part"]).drop("__part")
    return j.withColumn("norms", F.coalesce("norms", F.array().cast(lists.schema["norms"].dataType)))


def employee_norm_summary(t: Mapping[str, DataFrame]) -> DataFrame:
    """N2 summarised per employee (norm count, total norm quantity) by aggregation per position, no lists."""
    n = active_only(t["position_siz_norms"])
    items = t["siz_items"].select(F.col("id").alias("siz_item_id"))
    per_pos = (n.join(items, "siz_item_id").groupBy("position_id")
                .agg(F.count(F.lit(1)).alias("norms_count"), F.sum("quantity").cast("bigint").alias("norms_quantity")))
    e = t["employees"].select(F.col("id").alias("employee_id"), "position_id")
    j = e.join(per_pos, "position_id", "left")
    return j.select("employee_id", F.coalesce("norms_count", F.lit(0)).cast("bigint").alias("norms_count"),
                    F.coalesce("norms_quantity", F.lit(0)).cast("bigint").alias("norms_quantity"))
