"""Domain schemas (explicit StructTypes) and the conform step used when loading.

Ids are strings; ``extra``, ``changes`` and ``general_permissions`` are JSON text. Columns missing from a
source are added as typed NULLs, so older / partial layouts load into the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
          "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
          "decimal(10,2)": T.DecimalType(10, 2)}


def _schema(spec: str) -> T.StructType:
    """``"name type, ..."`` (flat columns of the types above) as a StructType; usable before any session exists."""
    fields = []
    for part in spec.split(", "):
        name, typ = part.strip().split(" ", 1)
        fields.append(T.StructField(name, _TYPES[typ.strip()], True))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "roles": _schema("id string, name string, display_name string, level string, description string, "
                     "general_permissions string, field_permissions string, created_at timestamp"),
    "organizations": _schema("id string, name string, code string, extra string, is_active boolean, "
                             "created_at timestamp"),
    "enterprises": _schema("id string, organization_id string, name string, code string, extra string, "
                           "is_active boolean, created_at timestamp"),
    "spbipk": _schema("id string, enterprise_id string, name string, code string, extra string, "
                      "is_active boolean, created_at timestamp"),
    "res_units": _schema("id string, enterprise_id string, spbipk_id string, name string, code string, "
                         "extra string, is_active boolean, created_at timestamp"),
    "departments": _schema("id string, res_unit_id string, name string, code string, extra string, "
                           "is_active boolean, created_at timestamp"),
    "users": _schema("id string, username string, full_name string, email string, phone string, role_id string, "
                     "organization_id string, enterprise_id string, res_unit_id string, spbipk_id string, "
                     "is_active boolean, last_login timestamp, created_at timestamp"),
    "positions": _schema("id string, name string, code string, enterprise_id string, res_unit_id string, "
                         "department_id string, extra string, is_active boolean, created_at timestamp"),
    "siz_categories": _schema("id string, name string, code string, extra string, is_active boolean, "
                              "created_at timestamp"),
    "siz_items": _schema("id string, category_id string, name string, code string, unit string, "
                         "wear_period_months int, gender string, season string, exploitation_months int, "
                         "exploitation_years decimal(10,2), extra string, is_active boolean, created_at timestamp"),
    "position_siz_norms": _schema("id string, position_id string, siz_item_id string, quantity int, "
                                  "issue_period_months int, extra string, is_active boolean, created_at timestamp"),
    "employees": _schema("id string, employee_number string, last_name string, first_name string, "
                         "middle_name string, position_id string, enterprise_id string, res_unit_id string, "
                         "department_id string, clothing_size string, shoe_size string, head_size string, "
                         "glove_size string, extra string, is_active boolean, created_at timestamp"),
    "siz_transactions": _schema("id string, employee_id string, siz_item_id string, transaction_type string, "
                                "quantity int, transaction_date date, valid_until date, issued_by string, "
                                "document_reference string, notes string, extra string, created_at timestamp"),
    "warehouses": _schema("id string, name string, warehouse_type string, spbipk_id string, res_unit_id string, "
                          "enterprise_id string, is_active boolean, created_at timestamp"),
    "warehouse_stock": _schema("id string, warehouse_id string, siz_item_id string, size_value string, "
                               "quantity int"),
    "stock_movements": _schema("id string, movement_type string, siz_item_id string, size_value string, "
                               "quantity int, from_warehouse_id string, to_warehouse_id string, employee_id string, "
                               "document_reference string, notes string, moved_by string, movement_date date, "
                               "created_at timestamp"),
    "employee_siz": _schema("id string, employee_id string, siz_item_id string, size_value string, quantity int, "
                            "issued_date date, exploitation_start date, exploitation_paused_days int, "
                            "status string, returned_date date, from_warehouse_id string, created_at timestamp"),
    "size_references": _schema("id string, category_type string, size_value string, sort_order int"),
    "seen_events": _schema("id string, batch bigint"),
    "audit_log": _schema("id string, user_id string, table_name string, record_id string, action string, "
                         "changes string, ip_address string, created_at timestamp"),
    # Request tables (one HTTP request of the original back end = one row here).
    "movement_events": _schema("event_id string, event_time timestamp, kind string, warehouse_id string, "
                               "to_warehouse_id string, siz_item_id string, size_value string, "
                               "employee_id string, holding_id string, quantity int, document_reference string, "
                               "notes string, actor_id string"),
    "import_employees": _schema("last_name string, first_name string, middle_name string, employee_number string, "
                                "enterprise_id string, res_unit_id string, department_id string, "
                                "position_id string, clothing_size string, shoe_size string"),
    "import_positions": _schema("name string, code string, enterprise_id string, res_unit_id string, "
                                "department_id string"),
    "import_items": _schema("name string, code string, category_id string, gender string, season string, "
                            "exploitation_months string, exploitation_years string, unit string"),
    "import_stock": _schema("siz_item_id string, size_value string, quantity string"),
}

# Tables with an is_active flag (soft delete).
SOFT_DELETE_TABLES = frozenset(
    n for n, s in SCHEMAS.items() if "is_active" in s.fieldNames()
)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select ``df`` into the domain schema of ``table``: cast present columns, add missing ones as typed NULLs.

    Extra columns are dropped. Pure projection: no shuffle, stays inside whole-stage codegen.
    """
    schema = SCHEMAS[table]
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name)
            if df.schema[f.name].dataType != f.dataType:
                c = c.cast(f.dataType)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
