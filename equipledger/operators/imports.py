"""Bulk imports (I1-I3; I4 = ledger.import_stock) and their summaries (A4).

The original looped over the payload row by row with one database round trip per row. Here a payload is a
DataFrame: validation is a projection, rejects are a filter, and the summary is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from equipledger.functions.scalars import DEFAULT_UNIT, js_falsy, js_or, js_parse_float, js_parse_int, js_round
from equipledger.operators.changes import audit_rows
from equipledger.schemas import conform

EMPLOYEE_FIELDS = ["first_name", "middle_name", "employee_number", "enterprise_id", "res_unit_id", "department_id",
                   "position_id", "clothing_size", "shoe_size"]
POSITION_FIELDS = ["code", "enterprise_id", "res_unit_id", "department_id"]


def import_summary(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """A4: row count per outcome (imported / skipped / error ...)."""
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("rows"))


def write_counted(rows: DataFrame, path: str, outcomes: tuple[str, ...], outcome: str = "outcome", keep: str = "imported") -> dict[str, int]:
    """A4 while writing: the rows whose outcome is ``keep`` go to ``path`` as Parquet, and all rows are counted per outcome on
    the way there, in the same job."""
    seen = Observation()
    counted = rows.observe(seen, *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])
    # the filter must not move below the counts: the observation is a node of the plan of its own, which Spark keeps in place
    counted.where(F.col(outcome) == keep).write.mode("overwrite").parquet(path)
    return {o: int(seen.get[o] or 0) for o in outcomes}


def _bulk_audit(imported: DataFrame, table: str, actor: str | None, batch: str | None) -> DataFrame:
    """One audit row per import with {"count": n}; record NULL (bulk)."""
    cnt = imported.agg(F.count(F.lit(1)).alias("count"))
    return audit_rows(cnt, table, "bulk_import", None, F.to_json(F.struct("count")), F.lit(actor).cast("string"),
                      salt=F.lit(batch))


def import_employees(rows: DataFrame, actor: str | None = None, batch: str | None = None) -> dict[str, DataFrame]:
    """Rows without last_name are dropped; other falsy fields ('' / NULL) become NULL."""
    r = conform(rows, "import_employees")
    keep = r.where(~js_falsy(F.col("last_name")))
    out = keep.select("last_name", *[js_or(c, F.lit(None).cast("string")).alias(c) for c in EMPLOYEE_FIELDS])
    out = out.withColumn("extra", F.lit("{}")).withColumn("is_active", F.lit(True))
    return {"rows": conform(out, "employees"), "dropped": r.where(js_falsy(F.col("last_name"))),
            "audit": _bulk_audit(out, "employees", actor, batch)}


def import_positions(rows: DataFrame, actor: str | None = None, batch: str | None = None) -> dict[str, DataFrame]:
    """Rows without name are dropped. Positions have no natural key, so ON CONFLICT never fires: an append
    (duplicates stay)."""
    r = conform(rows, "import_positions")
    keep = r.where(~js_falsy(F.col("name")))
    out = keep.select("name", *[js_or(c, F.lit(None).cast("string")).alias(c) for c in POSITION_FIELDS])
    out = out.withColumn("extra", F.lit("{}")).withColumn("is_active", F.lit(True))
    return {"rows": conform(out, "positions"), "dropped": r.where(js_falsy(F.col("name"))),
            "audit": _bulk_audit(out, "positions", actor, batch)}


def item_exploitation(months: F.Column, years: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """(exploitation_months, exploitation_years, bad) of an item row:
    months = parseInt(months) if months is truthy, else round(parseFloat(years) * 12) if years is truthy, else
    NULL; years = months / 12 to 2 digits when months is truthy. ``bad``: months came out NaN or beyond what the
    two columns hold (the original's INSERT failed there)."""
    m_given, y_given = ~js_falsy(months), ~js_falsy(years)
    from_months = js_parse_int(months)
    from_years = js_round(js_parse_float(years) * 12).try_cast("int")
    m = F.when(m_given, from_months).when(y_given, from_years)
    in_years = F.round(m / F.lit(12.0), 2).try_cast("decimal(10,2)")
    bad = (m_given | y_given) & (m.isNull() | in_years.isNull())
    return F.when(~bad, m), F.when(~bad & (m != 0), in_years), bad


def import_items(rows: DataFrame, mode: str = "quarantine", actor: str | None = None, batch: str | None = None
                 ) -> dict[str, DataFrame]:
    """Rows without name are dropped; months / years per ``item_exploitation``; unit defaults to 'шт'.

    A row whose number is NaN stopped the original import half-way (earlier rows stayed). Here the caller
    chooses: ``quarantine`` imports the good rows and returns the bad ones; ``all_or_nothing`` imports nothing
    when any row is bad."""
    r = conform(rows, "import_items")
    keep = r.where(~js_falsy(F.col("name")))
    m, y, bad = item_exploitation(F.col("exploitation_months"), F.col("exploitation_years"))
    x = keep.select("name", *[js_or(c, F.lit(None).cast("string")).alias(c)
                              for c in ("code", "category_id", "gender", "season")],
                    m.alias("exploitation_months"), y.alias("exploitation_years"),
                    js_or("unit", DEFAULT_UNIT).alias("unit"), bad.alias("__bad"))
    good = x.where(~F.col("__bad")).drop("__bad")
    rejected = x.where(F.col("__bad")).drop("__bad").withColumn("reason", F.lit("bad_number"))
    if mode == "all_or_nothing":
        good = good.where(rejected.select(F.count(F.lit(1))).scalar() == 0)
    out = conform(good.withColumn("extra", F.lit("{}")).withColumn("is_active", F.lit(True)), "siz_items")
    return {"rows": out, "rejected": rejected, "dropped": r.where(js_falsy(F.col("name"))),
            "audit": _bulk_audit(out, "siz_items", actor, batch)}
