"""K-d tree sharding: nodes are split at distributed weighted medians along their widest metadata dimension.

The driver sees only bounded histograms (at most nodes x ``BINS`` rows a pass); every pass reads one slim written
table. Law ``bytes``: leaves are near equal in bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import numbered, saved, table

SHARDS = 24
BINS = 512
TOLERANCE = 0.0005     # of a leaf's bytes: a median is refined until its bin weighs less, or is one key
DIMS = ["k_size", "k_lang", "k_source"]


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one sortable key per dimension: 31 bits of the value (size on a log scale, crc32
    of language and source), then 16 bits of the text's crc32 and 16 of the row's hash. So equal texts lie side by
    side and a group larger than a shard can still be cut. Null text has size 8; null values sort first."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    d = docs.select(F.col("doc_id"), size.alias("size"),
                    F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
                    F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    tie = (F.shiftright("text_crc32", 16).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
           + F.pmod(F.xxhash64("doc_id", "source", "lang"), F.lit(65536)))

    def key(value: Column) -> Column:
        return F.shiftleft(value.cast("long"), 32) + tie

    def code(c: str) -> Column:
        return F.coalesce(F.shiftright(F.crc32(F.col(c).cast("binary")), 1) + 1, F.lit(0))

    return d.select("doc_id", "size", "text_crc32", key(F.floor(F.log2(F.col("size").cast("double")) * (1 << 24))).alias("k_size"),
                    key(code("lang")).alias("k_lang"), key(code("source")).alias("k_source"))


def _of_node(values: list, kind: str = "bigint") -> Column:
    """The entry of ``values`` for the row's node (at most one value a shard)."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("node"))


def _medians(rows: DataFrame, goal: dict[int, int], lo: dict[int, int], hi: dict[int, int], slack: float, nodes: int) -> dict[int, int]:
    """For each node of ``goal`` the key up to which its ``rows(node, key, size)`` weigh that many bytes, within
    ``slack``: histograms of the interval that holds it, narrowed to one bin a pass for all nodes at once."""
    below, cut = dict.fromkeys(goal, 0), {}
    while len(cut) < len(goal):
        live = [i for i in goal if i not in cut]
        first = [lo[i] if i in live else None for i in range(nodes)]
        last = [hi[i] if i in live else None for i in range(nodes)]
        width = [(hi[i] - lo[i]) // BINS + 1 if i in live else None for i in range(nodes)]
        inside = rows.withColumns({"first": _of_node(first), "last": _of_node(last), "width": _of_node(width)})
        found = (inside.where("key between first and last").groupBy("node", F.expr("(key - first) div width").alias("bin"))
                 .agg(F.sum("size").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("z")).collect())
        for i in live:
            bins = sorted((r for r in found if r["node"] == i), key=lambda r: r["bin"])
            weight = below[i]
            for r in bins:
                if weight + r["bytes"] >= goal[i]:
                    break
                weight += r["bytes"]
            if r["a"] == r["z"] or r["bytes"] <= slack:
                # take this bin or leave it, whichever ends nearer
                cut[i] = r["z"] if weight + r["bytes"] - goal[i] <= goal[i] - weight else r["a"] - 1
            else:
                lo[i], hi[i], below[i] = r["a"], r["z"], weight
    return cut


def kd_tree(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` with ``shard``, the number of their leaf from left to right. A level is one pass for the ranges, a few
    for the medians and one that writes every row's node; only ranges and histograms reach the driver."""
    rows, nodes, span = rows.withColumn("node", F.lit(0)), [leaves], None
    while max(nodes) > 1:
        stats = {r["node"]: r for r in rows.groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{k}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if not stats:
            break
        span = span or {d: max(1, stats[0][f"{d}_hi"] - stats[0][f"{d}_lo"]) for d in DIMS}
        live = [i for i, n in enumerate(nodes) if n > 1 and i in stats]
        widest = {i: max(DIMS, key=lambda d, s=stats[i]: (s[f"{d}_hi"] - s[f"{d}_lo"]) / span[d]) for i in live}
        dim = _of_node([DIMS.index(widest[i]) if i in widest else None for i in range(len(nodes))], "int")
        keyed = rows.withColumn("key", F.get(F.array(*DIMS), dim))
        goal = {i: stats[i]["bytes"] * (nodes[i] // 2) // nodes[i] for i in live}
        slack = TOLERANCE * min((stats[i]["bytes"] / nodes[i] for i in live), default=0)
        cut = _medians(keyed.select("node", "key", "size"), goal, {i: stats[i][f"{widest[i]}_lo"] for i in live},
                       {i: stats[i][f"{widest[i]}_hi"] for i in live}, slack, len(nodes))
        child, grown = [], []
        for n in nodes:               # a node without rows is split all the same, so that shards keep their numbers
            child.append(len(grown))
            grown += [n // 2, n - n // 2] if n > 1 else [1]
        right = F.coalesce((F.col("key") > _of_node([cut.get(i) for i in range(len(nodes))])).cast("int"), F.lit(0))
        rows = saved(keyed.withColumn("node", _of_node(child, "int") + right).drop("key"), "shard-level")
        nodes = grown
    return rows.withColumnRenamed("node", "shard")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard).

    Give the number of shards, or ``target_bytes`` of a leaf. Leaves differ from equal bytes by about one row (or
    one key's rows if 16 bits of hash can't tell them apart). Null ids, texts and metadata are values like others;
    repeated rows all stay; extra columns are ignored; an empty table gives no rows."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    slim = saved(metadata(docs), "shard-rows")
    if shards is None:
        total = slim.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = kd_tree(slim, shards).select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"])


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    "slot", F.lit(None).cast("int").alias("grown_shard"))
