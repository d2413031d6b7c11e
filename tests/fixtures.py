"""Small hand-made domain tables for unit tests."""

import datetime as dt

from equipledger.schemas import SCHEMAS, conform


def frame(spark, table, rows):
    """rows: list of dicts with a subset of the table's columns."""
    schema = SCHEMAS[table]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return conform(spark.createDataFrame(full, schema), table)


def D(s):
    return dt.date.fromisoformat(s)


def org(spark):
    """Organisation with one enterprise (E1), one spbipk under it, one res unit with a department."""
    t = {
        "organizations": frame(spark, "organizations", [{"id": "O1", "name": "Org", "is_active": True}]),
        "enterprises": frame(spark, "enterprises", [
            {"id": "E1", "organization_id": "O1", "name": "Ent 1", "is_active": True},
            {"id": "E2", "organization_id": "O1", "name": "Ent 2", "is_active": True}]),
        "spbipk": frame(spark, "spbipk", [{"id": "S1", "enterprise_id": "E1", "name": "Sp 1", "is_active": True}]),
        "res_units": frame(spark, "res_units", [
            {"id": "R1", "enterprise_id": "E1", "spbipk_id": "S1", "name": "Res 1", "is_active": True}]),
        "departments": frame(spark, "departments", [
            {"id": "D1", "res_unit_id": "R1", "name": "Dep 1", "is_active": True}]),
        "positions": frame(spark, "positions", [{"id": "P1", "name": "Electrician", "enterprise_id": "E1",
                                                  "is_active": True}]),
        "siz_categories": frame(spark, "siz_categories", [
            {"id": "C1", "name": "Helmets", "code": "helmets", "is_active": True},
            {"id": "C2", "name": "Empty", "code": "empty", "is_active": True}]),
        "siz_items": frame(spark, "siz_items", [
            {"id": "I1", "category_id": "C1", "name": "Каска", "code": "K-1", "unit": "шт",
             "exploitation_months": 1, "exploitation_years": None, "is_active": True},
            {"id": "I2", "category_id": "C1", "name": "Helmet", "code": "H-2", "unit": "шт",
             "exploitation_months": None, "is_active": True},
            {"id": "I3", "category_id": "C1", "name": "Old", "code": "O-3", "unit": "шт",
             "exploitation_months": 12, "is_active": False}]),
        "warehouses": frame(spark, "warehouses", [
            {"id": "W1", "name": "Direct", "warehouse_type": "spbipk", "enterprise_id": "E1", "is_active": True},
            {"id": "W2", "name": "Via spbipk", "warehouse_type": "spbipk", "spbipk_id": "S1", "is_active": True},
            {"id": "W3", "name": "Res wh", "warehouse_type": "res", "res_unit_id": "R1", "enterprise_id": "E1",
             "is_active": True},
            {"id": "W4", "name": "Central", "warehouse_type": "ia", "is_active": True},
            {"id": "W5", "name": "Other", "warehouse_type": "other", "is_active": False}]),
        "employees": frame(spark, "employees", [
            {"id": "U1", "last_name": "Иванов", "position_id": "P1", "enterprise_id": "E1", "res_unit_id": "R1",
             "department_id": "D1", "is_active": True},
            {"id": "U2", "last_name": "Петров", "position_id": "P1", "enterprise_id": "E1", "is_active": True},
            {"id": "U3", "last_name": "Central", "position_id": "P1", "is_active": True},
            {"id": "U4", "last_name": "Gone", "position_id": "P1", "enterprise_id": "E1", "is_active": False}]),
        "users": frame(spark, "users", []),
        "roles": frame(spark, "roles", []),
    }
    return t
