"""Constraint checks as DataFrame operators (F11-F14): each splits input rows into good rows and rejects with
a reason, instead of failing a whole statement as a database constraint would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipledger.functions.scalars import js_falsy

# The CHECK constraint lists of the original schema.
ALLOWED_VALUES = {
    "roles.level": ("ia", "enterprise", "spbipk", "res"),
    "positions.level": ("ia", "enterprise", "res"),
    "siz_transactions.transaction_type": ("issue", "return", "write_off", "exchange"),
    "field_access_rules.access_level": ("read", "write", "none"),
    # The older DDL limited audit actions to create / update / delete; the running schema has no such check
    # (bulk imports write 'bulk_import'), and that schema is followed.
}


def check_values(df: DataFrame, col: str, allowed) -> tuple[DataFrame, DataFrame]:
    """CHECK (col IN allowed). SQL CHECK passes NULL."""
    ok = F.col(col).isNull() | F.col(col).isin(*allowed)
    return df.where(ok), df.where(~ok).withColumn("reason", F.lit(f"{col}_not_allowed"))


def check_references(df: DataFrame, fk: str, parent: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """the foreign key must exist in ``parent``; a NULL foreign key passes. Semi / anti join (the parent
    keys are broadcast when proven small)."""
    keys = parent.select(F.col(key).alias(fk)).distinct()
    nulls = df.where(F.col(fk).isNull())
    present = df.where(F.col(fk).isNotNull())
    good = present.join(keys, fk, "left_semi").unionByName(nulls)
    bad = present.join(keys, fk, "left_anti").withColumn("reason", F.lit(f"{fk}_missing"))
    return good, bad


def check_required(df: DataFrame, cols: list[str], api: bool = True, numeric: tuple[str, ...] = ()
                   ) -> tuple[DataFrame, DataFrame]:
    """required fields. ``api`` applies the request check (JS falsiness: '' and 0 fail too); otherwise
    only NOT NULL."""
    miss = [F.when(js_falsy(F.col(c), c in numeric) if api else F.col(c).isNull(), F.lit(c)) for c in cols]
    missing = F.filter(F.array(*miss), lambda x: x.isNotNull())
    x = df.withColumn("__missing", missing)
    good = x.where(F.size("__missing") == 0).drop("__missing")
    bad = x.where(F.size("__missing") > 0).withColumn("reason", F.concat(F.lit("missing:"),
                                                                         F.array_join("__missing", ","))) \
        .drop("__missing")
    return good, bad


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """natural keys that occur more than once, with their count (partial + final aggregation)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
