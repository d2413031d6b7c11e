"""Seed rows (M7) and the size list: fixed values of the original's set-up, inserted where they are absent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.operators.changes import insert_absent
from equipledger.operators.filters import filter_equal
from equipledger.operators.reports import in_report_order

# Fixed values.
CATEGORIES = [("Спецодежда", "clothes"), ("Обувь", "shoes"), ("Каски", "helmets"), ("СИЗ", "ppe"), ("Перчатки", "gloves"),
              ("Моющие средства", "detergents")]
ORGANIZATION = ("Россети-Юг", "Кубаньэнерго")
SHOE_SIZES = range(35, 50)
CHEST_SIZES = range(40, 73, 4)                       # 40-42, 44-46, ... 72-74
HEIGHTS = ("158-164", "170-176", "182-188", "194-200")
ONE_SIZE = [("head", "Универсальный"), ("gloves", "Универсальный"), ("consumable", "Ручной ввод")]


def size_rows() -> list[tuple[str, str, int]]:
    """(category_type, size_value, sort_order): shoe sizes, every clothing size at every height, and the single ones."""
    clothes = [f"{c}-{c + 2}/{h}" for c in CHEST_SIZES for h in HEIGHTS]
    return [("shoes", str(s), i) for i, s in enumerate(SHOE_SIZES, 1)] + [
        ("clothing", c, i) for i, c in enumerate(clothes, 1)] + [(t, s, 1) for t, s in ONE_SIZE]


def seed(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """M7: the categories only into an empty table, the organisation unless its code is there, sizes unless (type, value) is.
    Seeding twice changes nothing."""
    true = F.lit(True).alias("is_active")
    cats = spark.createDataFrame(CATEGORIES, "name string, code string").select("*", F.lit("{}").alias("extra"), true)
    org = spark.createDataFrame([ORGANIZATION], "name string, code string").select("*", F.lit("{}").alias("extra"), true)
    sizes = spark.createDataFrame(size_rows(), "category_type string, size_value string, sort_order int")
    return {"siz_categories": insert_absent(tables["siz_categories"], cats, ["code"], only_into_empty=True),
            "organizations": insert_absent(tables["organizations"], org, ["code"]),
            "size_references": insert_absent(tables["size_references"], sizes, ["category_type", "size_value"])}


def sizes_report(sizes: DataFrame, category_type: str | None = None) -> DataFrame:
    """The size list of a category type (or all), in its own order."""
    return in_report_order(filter_equal(sizes, {"category_type": category_type}), "sizes")
