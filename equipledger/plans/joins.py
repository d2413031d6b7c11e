"""Label joins. The join strategy is left to Spark: a side is broadcast when its size in bytes is known to lie under
``spark.sql.autoBroadcastJoinThreshold`` (from the scan when planned, from the finished shuffle under AQE), and AQE
splits the partition of a hot key otherwise. Building a join starts no job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_PARTS = 64   # rows without a foreign key are spread over this many values that match nothing
PAIRS = 1 << 24   # joined rows that one part of a key makes


def left_labels(fact: DataFrame, dim: DataFrame, fk: str, key: str = "id", cols: dict[str, str] | None = None
                ) -> DataFrame:
    """LEFT JOIN ``dim`` on ``fact.fk = dim.key`` to attach display columns ``{dim_col: alias}``.

    The dimension is projected to its key + label columns first (column pruning reaches the scan), and
    deduplication is not needed: ``key`` is the dimension's primary key.
    """
    cols = cols or {"name": fk.removesuffix("_id") + "_name"}
    k = f"__k_{fk}"
    d = dim.select(F.col(key).alias(k), *[F.col(c).alias(a) for c, a in cols.items()])
    return null_safe_left(fact, d, fk, k).drop(k)


def null_safe_left(fact: DataFrame, dim: DataFrame, fk: str, key: str) -> DataFrame:
    """LEFT JOIN on ``fact.fk = dim.key`` (text keys) where many ``fk`` may be NULL: those rows match nothing, and
    are spread by their id, so that a shuffle does not put them all into one partition."""
    if "id" not in fact.columns:
        return fact.join(dim, fact[fk] == dim[key], "left")
    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(fact["id"]), F.lit(NULL_PARTS)).cast("string"))
    return fact.join(dim, F.coalesce(fact[fk], nowhere) == dim[key], "left")


def dealt(many: DataFrame, lists: DataFrame, key: str, by: str, length: Column | None = None, pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` whose result is far larger than they are, with ``__part`` to join on as well. A key is cut
    into as many parts as it makes ``pairs`` (``PAIRS``) joined rows: rows of ``many`` go to a part by a hash of ``by``, those of ``lists``
    (each worth ``length`` rows, default 1) to every part. Sizes in bytes, by which Spark joins partitions and splits hot
    ones, say nothing of the result, so the rows are dealt to a given number of partitions."""
    n = many.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    m = lists.groupBy(F.col(key).alias("__k")).agg(F.sum(length if length is not None else F.lit(1)).alias("__m"))
    parts = n.join(m, "__k").select("__k", F.greatest(F.lit(1), F.ceil(F.col("__n") * F.col("__m") / (pairs or PAIRS))).cast("int").alias("__parts"))
    at = F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(NULL_PARTS))).cast("int")       # a key without a list matches nothing
    left = many.join(parts, F.col(key) == F.col("__k"), "left").withColumn("__part", at).drop("__k", "__parts")
    right = lists.join(parts, F.col(key) == F.col("__k")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, key, "__part"), right.drop("__k", "__parts").repartition(tasks, key, "__part")
