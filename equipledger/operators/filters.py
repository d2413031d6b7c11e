"""Projections, filters and predicates (F1-F3, F6-F10). Every filter is a Column predicate that Catalyst can
push through joins and unions down to the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipledger.functions.scalars import (HOLDING_ACTIVE, SOURCE_EMPLOYEE, SOURCE_WAREHOUSE, STATUS_EXPIRED,
                                           STATUS_ISSUED, ilike_contains, within_days)


def active_only(df: DataFrame, col: str = "is_active") -> DataFrame:
    """``is_active = true``; NULL is dropped."""
    return df.where(F.col(col))


def equal_predicate(filters: dict | None, prefix: str = "") -> Column | None:
    """AND of equality tests; absent / empty values add nothing (as absent query parameters)."""
    preds = [F.col(prefix + k) == F.lit(v) for k, v in (filters or {}).items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, preds) if preds else None


def filter_equal(df: DataFrame, filters: dict | None) -> DataFrame:
    """F2."""
    p = equal_predicate(filters)
    return df if p is None else df.where(p)


def search(df: DataFrame, text: str | None, cols: list[str]) -> DataFrame:
    """OR of case-insensitive substring matches; ``%`` and ``_`` in ``text`` act as wildcards."""
    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, [ilike_contains(c, text) for c in cols]))


def in_stock(stock: DataFrame) -> DataFrame:
    """F6."""
    return stock.where(F.col("quantity") > 0)


def active_holdings(h: DataFrame) -> DataFrame:
    """F7."""
    return h.where(F.col("status") == HOLDING_ACTIVE)


def cards_by_status(cards: DataFrame, status: str | None, as_of=None) -> DataFrame:
    """F8: card status filter; unknown / empty status adds nothing."""
    st, src = F.col("status"), F.col("source_type")
    if status == "expired":
        return cards.where(st == STATUS_EXPIRED)
    if status == "expiring_soon":
        return cards.where((src == SOURCE_EMPLOYEE) & within_days(F.col("exploitation_end"), as_of))
    if status == "in_stock":
        return cards.where(src == SOURCE_WAREHOUSE)
    if status == "issued":
        return cards.where((src == SOURCE_EMPLOYEE) & (st == STATUS_ISSUED))
    return cards


def cards_by_place(cards: DataFrame, wh_type: str | None) -> DataFrame:
    """'employee' keeps held equipment; any other non-empty value keeps stock of that warehouse type."""
    if not wh_type:
        return cards
    if wh_type == "employee":
        return cards.where(F.col("source_type") == SOURCE_EMPLOYEE)
    return cards.where((F.col("source_type") == SOURCE_WAREHOUSE) & (F.col("warehouse_type") == wh_type))


def at_warehouse(moves: DataFrame, warehouse_id: str) -> DataFrame:
    """F10 for one warehouse: ``from = id OR to = id``."""
    return moves.where((F.col("from_warehouse_id") == warehouse_id) | (F.col("to_warehouse_id") == warehouse_id))


def by_warehouse(moves: DataFrame, out_col: str = "warehouse_id") -> DataFrame:
    """F10 for every warehouse at once: each movement once per distinct warehouse it touches.

    ``explode(array_distinct(array(from, to)))`` turns the OR of two keys into one equi-key, so a later
    join / window on ``out_col`` hash-partitions instead of planning a nested loop. A transfer to itself
    appears once.
    """
    wh = F.explode(F.array_distinct(F.filter(F.array("from_warehouse_id", "to_warehouse_id"),
                                             lambda x: x.isNotNull())))
    return moves.select("*", wh.alias(out_col))
