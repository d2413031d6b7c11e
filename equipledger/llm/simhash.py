"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``(max_distance + 1) // 2`` segments, so that of two fingerprints within the
distance at least one segment pair differs by at most one bit. Every segment is indexed under each one-bit
wildcard; fingerprints that meet under a wildcard are joined by equality and verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.llm.common import saved, table
from equipledger.llm.components import connected_components

SHINGLE = 3
MAX_DISTANCE = 3
CHUNK = 2048          # members of one signature compared in one group of work; larger ones are cut into chunk pairs


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the whole text as a signed long: bit set if set in over half of the shingle hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    hs = np.array([h64(joined[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                  dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hs), 4096):
        part = hs[i:i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * total > len(hs)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; null, empty or blank text has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(max_distance: int) -> int:
    return max(1, (max_distance + 1) // 2)


def _signatures(reps: DataFrame, max_distance: int) -> DataFrame:
    """One row per fingerprint, segment and wildcard: ``sig`` is (segment, wildcard, segment's other bits), ``bit``
    the wildcard's own bit. Segment widths differ by at most one and add up to 64."""
    n = segments(max_distance)
    cuts = [64 * i // n for i in range(n + 1)]
    variants = [(s, cuts[s], cuts[s + 1] - cuts[s], j) for s in range(n) for j in range(cuts[s + 1] - cuts[s])]
    cols = []
    for s, at, width, j in variants:
        v = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        bit = F.shiftrightunsigned(v, j).bitwiseAND(F.lit(1))
        rest = v.bitwiseAND(F.lit(~(1 << j) if j < 63 else 0x7FFFFFFFFFFFFFFF))
        cols.append(F.struct(F.lit(s * 64 + j).cast("int").alias("slot"), rest.alias("rest"), bit.cast("int").alias("bit")))
    return reps.select("id", "fp", F.explode(F.array(*cols)).alias("x")).select("id", "fp", "x.slot", "x.rest", "x.bit")


def _near(a: str, b: str, d: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= d


def _forest(fp: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Edges that span the same components as all pairs (one of ``left``, one of ``right``) within distance ``d``."""
    fp = fp.astype(np.int64).view(np.uint64)      # bit counts of signed numbers are those of their absolute values
    label, out = np.arange(len(fp)), []
    other = fp[right]
    for i in left.tolist():
        near = right[np.bitwise_count(other ^ fp[i]) <= d]
        if not len(near):
            continue
        found, first = np.unique(label[near], return_index=True)
        own = label[i]
        for lab, at in zip(found.tolist(), near[first].tolist()):
            if lab != own:
                out.append((int(ids[i]), int(ids[at])))
                label[label == lab] = own
    return out


def _crowds(max_distance: int):
    """Over rows sorted by (slot, rest, ci, cj): the forest of each crowd; a crowd may span Arrow batches."""
    def work(key, fp, ids, bit, chunk):
        slot, _, ci, cj = key
        everyone = slot % 64 == 0          # wildcard 0 also holds the pairs whose segments are equal
        edges = []
        for x, y in ([(0, 1)] if ci == cj else [(0, 1), (1, 0)]) + ([(0, 0), (1, 1)] if everyone else []):
            left, right = np.flatnonzero((bit == x) & (chunk == ci)), np.flatnonzero((bit == y) & (chunk == cj))
            if len(left) and len(right):
                edges += _forest(fp, ids, left, right, max_distance)
        return edges

    def run(batches):
        rest = None
        names = ["slot", "rest", "ci", "cj", "fp", "id", "bit", "chunk"]
        def flush(cols, last):
            keys = np.stack([cols[n].astype(np.int64) for n in names[:4]])
            n = keys.shape[1]
            if not n:
                return [], None
            at = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [n]))
            stop = len(at) - 1 if last else len(at) - 2
            edges = []
            for k in range(stop):
                a, z = at[k], at[k + 1]
                edges += work(tuple(keys[:, a].tolist()), cols["fp"][a:z], cols["id"][a:z], cols["bit"][a:z], cols["chunk"][a:z])
            return edges, None if last else {n: v[at[stop]:] for n, v in cols.items()}

        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            if rest is not None:
                cols = {n: np.concatenate((rest[n], cols[n])) for n in names}
            edges, rest = flush(cols, False)
            yield _edge_batch(edges)
        if rest is not None:
            yield _edge_batch(flush(rest, True)[0])

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def near_edges(reps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``reps(id, fp)``, one row per fingerprint -> edges ``(a, b)`` with the components of all pairs in reach.

    A signature met by two fingerprints gives its pair at once from a min and max (no group is gathered). Larger
    crowds are cut into chunks of about ``CHUNK`` members; every chunk pair is a group of work of its own, which
    verifies all 64 bits and returns a spanning forest, so the output stays linear in the crowd."""
    # a few bytes a row before, 64 rows after: dealt out first, by a number of parts that isn't coalesced
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = _signatures(reps.repartition(parts, "id"), max_distance)
    member = F.struct("fp", "id", "bit")
    met = (sigs.groupBy("slot", "rest")
           .agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("lo"), F.max(member).alias("hi"),
                F.min("bit").alias("b0"), F.max("bit").alias("b1"))
           .where((F.col("n") > 1) & ((F.col("slot") % 64 == 0) | (F.col("b0") < F.col("b1")))))
    met = saved(met, "met")
    pairs = (met.where("n = 2").select(F.col("lo.id").alias("a"), F.col("hi.id").alias("b"),
                                       F.col("lo.fp").alias("x"), F.col("hi.fp").alias("y"))
             .where(_near("x", "y", max_distance)).select("a", "b"))
    crowd = met.where("n > 2").select(F.col("slot").alias("c_slot"), F.col("rest").alias("c_rest"),
                                      F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    inside = (sigs.join(crowd, (F.col("slot") == F.col("c_slot")) & (F.col("rest") == F.col("c_rest")))
              .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
              .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("slot", "rest", F.least("chunk", "k").alias("ci"), F.greatest("chunk", "k").alias("cj"),
                      "fp", "id", "bit", "chunk"))
    spans = (inside.repartition("slot", "rest", "ci", "cj").sortWithinPartitions("slot", "rest", "ci", "cj")
             .mapInArrow(_crowds(max_distance), "a long, b long"))
    return pairs.unionByName(spans)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: component_id is the smallest doc_id reachable by links of at
    most ``max_distance`` differing bits, the document itself included.

    Equal fingerprints are first put together (one node each, named by its smallest doc_id). Rows with a null id
    keep a null id; they can link others but only a real id can name a group (a group without one has null).
    Repeated rows and ties give the same group; extra columns are ignored; an empty table gives no rows."""
    fps = saved(fingerprints(docs, shingle), "fps")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    # a fingerprint that only rows without an id have takes part under a node of its own, below no real id
    reps = reps.select("fp", "low", F.coalesce("low", F.xxhash64("fp").bitwiseOR(F.lit(0x4000000000000000))
                                               .bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))).alias("id"))
    reps = saved(reps, "reps")
    comp = connected_components(near_edges(reps.select("id", "fp"), max_distance))
    named = (reps.join(comp.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
             .select("fp", "low", F.coalesce("component_id", "id").alias("component")))
    real = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "component").join(real, "component").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id. All columns are kept.

    Of repeated rows of one id one stays (the least by text); rows without an id stay unless they repeat a text."""
    gone = (near_groups(docs, shingle, max_distance).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone")).distinct())
    rest = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    w = Window.partitionBy("doc_id", "__anon").orderBy("__text")
    return (rest.withColumn("__text", F.xxhash64("text"))
            .withColumn("__anon", F.when(F.col("doc_id").isNull(), F.col("__text")))
            .withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__text", "__anon"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
