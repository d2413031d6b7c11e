"""Joins whose result is far larger than their sides: the result is made by many tasks, whatever the sides' bytes."""

import pytest
from pyspark.sql import functions as F

from equipledger.operators import nested as N
from equipledger.operators import reports as R
from equipledger.plans import joins
from equipledger.schemas import SCHEMAS, empty

PEOPLE, NORMS = 600, 50


@pytest.fixture()
def tables(spark, monkeypatch):
    """Most employees have one position; others have none, one without norms, or none that is known; one row comes twice."""
    monkeypatch.setattr(joins, "PAIRS", 1000, raising=False)
    position = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "bare").when(F.col("id") % 10 == 2, "?").otherwise("hot")
    people = spark.range(0, PEOPLE, 1, 1).select(F.col("id").cast("string").alias("id"), position.alias("position_id"), (F.col("id") % 2 == 0).alias("is_active"))
    norms = spark.range(NORMS).select(F.col("id").cast("string").alias("id"), F.lit("hot").alias("position_id"), F.col("id").cast("string").alias("siz_item_id"),
                                      F.lit(1).alias("quantity"), F.lit(True).alias("is_active"))
    items = spark.range(NORMS).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("item "), "id").alias("name"), (F.col("id") != 7).alias("is_active"))
    own = {"employees": people, "position_siz_norms": norms.unionByName(norms.limit(1)), "siz_items": items}
    full = {k: d.select(*[(F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[k].fields])
            for k, d in own.items()}
    return {**{k: empty(spark, k) for k in SCHEMAS}, **full}


def tasks(df):
    """Number of tasks that make rows, and the largest one's rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return len(n), max(n)


HOT = sum(i % 10 > 2 for i in range(PEOPLE))


def test_entitlements_are_made_by_many_tasks(tables):
    got = R.entitlements(*[tables[k] for k in ("employees", "position_siz_norms", "siz_items", "siz_categories")])
    rows = got.select("employee_id", "id").collect()
    again = {r.id for r in tables["position_siz_norms"].groupBy("id").count().where("count > 1").select("id").collect()}
    assert len(rows) == HOT * (NORMS - 1 + len(again - {"7"}))
    assert {(r.employee_id, r.id) for r in rows} == {(str(i), str(k)) for i in range(PEOPLE) if i % 10 > 2 for k in range(NORMS) if k != 7}
    many, largest = tasks(got)
    assert many > 2 and largest < 0.6 * len(rows)


def test_cards_are_exploded_by_many_tasks(tables):
    cards = N.employee_cards(tables)
    rows = cards.collect()
    assert len(rows) == PEOPLE and cards.columns[-1] == "norms" and not [c for c in cards.columns if c.startswith("__")]
    assert {r.id for r in rows if len(r.norms) == NORMS + 1} == {str(i) for i in range(PEOPLE) if i % 10 > 2}
    assert all(r.norms == [] for r in rows if int(r.id) % 10 <= 2)
    many, largest = tasks(cards.select("id", F.explode_outer("norms")))
    assert many > 2 and largest < 0.6 * HOT * (NORMS + 1)
