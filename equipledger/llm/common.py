"""Helpers shared by the training-data operators.

Result tables that are read more than once are written to the shared folder the cluster names in
``spark.checkpoint.dir`` (never to a local one), so that a lost executor costs a re-read and not the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.session import shared_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read again with the same schema."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``file_name`` and ``file_row`` (the row's index in that file), and ``(file_name, file_start)``, the rows
    in the files before: together a row's place in the order the table was written in. Reading packs files by size, so
    that order is in the files alone. What is not a table just read is written first."""
    if df._jdf.queryExecution().analyzed().nodeName().split()[0] not in ("Relation", "LogicalRelation"):
        df = saved(df, "placed")
    at = df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("file_row"))
    part = F.regexp_extract("file_name", r"^part-(\d+)", 1).try_cast("long")
    files = Window.partitionBy(F.lit(0)).orderBy(part, "file_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).select(
        "file_name", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("file_start"))
    return at, starts


def doc_bucket(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def sample_ids(df: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` distinct doc ids, spread by hash: the bound that makes a broadcast of them safe."""
    return (df.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def numbered(df: DataFrame, group: list[str], order: list[str], size: str | None = None,
             rows_per_part: int = 10_000) -> DataFrame:
    """Adds ``slot`` (gapless from 0 within ``group``) and, if ``size`` is given, ``before`` (sum of it over the
    rows in front), without one task per group: rows are dealt to hash parts of a group, numbered inside a part and
    lifted by the totals of the parts before it. The number of parts follows the number of rows.

    Rows equal in ``order`` may swap slots. Null groups form a group of their own. Empty input gives no rows.
    """
    n = df.count()
    parts = n // rows_per_part + 1
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    d = df.withColumn("__part", part)
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(size).alias("__s")] if size else [])
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lift = d.groupBy(*group, "__part").agg(*sums)
    lift = lift.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__g_part"),
                       F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__lift_n"),
                       *([F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__lift_s")] if size else []))
    own = Window.partitionBy(*group, "__part").orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(own) - 1)
    if size:
        d = d.withColumn("__run", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] + [F.col("__part") == F.col("__g_part")]
    out = d.join(lift, on, "inner").withColumn("slot", (F.col("__rn") + F.col("__lift_n")).cast("long"))
    if size:
        out = out.withColumn("before", (F.col("__run") + F.col("__lift_s")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def head_of(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The most frequent rows of ``counts``, at most ``limit`` of them (whole classes of near-equal counts), found by a
    log histogram: the bound that makes a broadcast of them safe, without a global sort."""
    grade = F.floor(F.log2(F.col(n).cast("double")) * 16)
    rows = sorted(counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["g"])
    total, least = 0, None
    for r in rows:
        if total + r["k"] > limit:
            break
        total, least = total + r["k"], r["g"]
    return counts.where(F.lit(False) if least is None else grade >= least)
