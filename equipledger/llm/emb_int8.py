"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale per vector; the length of what quantisation leaves out is known per
vector, so |cos - approx| <= |xq| * ey + ex. Only the int8 codes travel to the tile pairs. A pair whose lower bound
reaches the threshold is a link, one whose upper bound doesn't is none; the vectors of the pairs between are
fetched, and only those pairs are computed anew in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import numbered, saved, table
from equipledger.llm.components import connected_components

THRESHOLD = 0.95
TILE_BYTES = 1 << 22      # int8 codes of a tile at most: a task holds two tiles
LEAST_ROWS = 512          # vectors of a tile at least, where the table has them
LEAST_TILES = 10          # tiles a table is cut into at least; each one is sent once for every tile
MOST_TASKS = 20_000       # tasks the tile pairs are dealt to
BLOCK = 2048              # rows and columns of a product held at a time
EXACT_DIMS = 1024         # 127 * 127 * 1024 < 2**24: sums of int8 products are exact in float32


def plain(x: np.ndarray) -> np.ndarray:
    """Rows as they are, but those whose squares would leave the range of doubles divided by their largest value."""
    big = np.abs(x).max(axis=1, initial=0.0)
    far = (big > 1e150) | (big < 1e-150)
    if not far.any():
        return x
    return np.where(far[:, None], x / np.where(big > 0, big, 1.0)[:, None], x)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def above(x: np.ndarray) -> np.ndarray:
    """float32 values not below ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, and upper bounds of the length of the quantised vector and of the error, per row of unit
    vectors. The scale is a float32 number, rounded up so that no code leaves -127..127."""
    scale = above(np.abs(unit).max(axis=1, initial=0.0) / 127.0)
    q = np.rint(unit / scale[:, None].astype(np.float64))
    near = q * scale[:, None].astype(np.float64)
    return q.astype(np.int8), scale, above(np.linalg.norm(near, axis=1)), above(np.linalg.norm(unit - near, axis=1))


def slack(dim: int) -> float:
    """More than the rounding of lengths, bounds and products in doubles adds up to, for ``dim`` components."""
    return (dim + 16) * 2.0 ** -49


class Tile:
    def __init__(self, ids, copies, codes, scale, near, error):
        self.ids, self.copies, self.codes = ids, copies, codes
        self.scale, self.near, self.error = (v.astype(np.float64) for v in (scale, near, error))


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of int8 rows."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k:k + EXACT_DIMS].astype(np.float32) @ b[:, k:k + EXACT_DIMS].astype(np.float32).T).astype(np.float64)
               for k in range(0, a.shape[1], EXACT_DIMS))


def tile_pairs(a: Tile, b: Tile, threshold: float, same: bool):
    """Yields ``(i, j, sure)`` block by block: the pairs of rows whose upper bound reaches the threshold, each once, and
    whether the lower bound does. What a pair is depends on its two rows alone, not on the tile around them."""
    low = slack(a.codes.shape[1])
    for at in range(0, len(a.ids), BLOCK):
        rows = slice(at, at + BLOCK)
        for to in range(at if same else 0, len(b.ids), BLOCK):
            cols = slice(to, to + BLOCK)
            dots = int_products(a.codes[rows], b.codes[cols])
            # a coarse sieve with the block's largest error, 1e-5 wide for float32; the bounds below decide
            least = (threshold - 1e-5 - a.near[rows] * b.error[cols].max() - a.error[rows]) / a.scale[rows]
            i, j = np.nonzero(dots * b.scale[cols].astype(dots.dtype) >= least[:, None].astype(dots.dtype))
            if same and at == to:
                i, j = i[j > i], j[j > i]
            s = dots[i, j].astype(np.float64)
            i, j = i + at, j + to
            approx = s * a.scale[i] * b.scale[j]
            bound = a.near[i] * b.error[j] + a.error[i] + low
            hit = approx + bound >= threshold
            if hit.any():
                yield i[hit], j[hit], (approx - bound)[hit] >= threshold


class Forest:
    """Links among ``n`` nodes, added in blocks: rows linked to a node, and edges that keep the components."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.found = copies, np.zeros(len(copies))
        self.root, self.edges = np.arange(len(copies)), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.copies)
        self.found += np.bincount(i, weights=self.copies[j], minlength=n) + np.bincount(j, weights=self.copies[i], minlength=n)
        self.edges += spanning(self.root, i, j)

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kind, a, b: 0, node and rows it links to; 1, the ends of an edge."""
        some = np.flatnonzero(self.found)
        i, j = (np.concatenate([e[k] for e in self.edges]) if self.edges else np.zeros(0, np.int64) for k in (0, 1))
        return (np.concatenate((np.zeros(len(some), np.int32), np.ones(len(i), np.int32))),
                np.concatenate((ids[some], ids[i])), np.concatenate((self.found[some].astype(np.int64), ids[j])))


def spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Those of the edges (i, j) that join components of ``root`` (changed in place): every root is hooked to its
    smallest neighbour root, all nodes at once."""
    kept = []
    while len(i):
        a, b = root[i], root[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        if not len(i):
            break
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((lo, hi))
        first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
        kept.append((i[first], j[first]))
        root[hi[first]] = lo[first]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
    return kept


def valid(vector: str = "embedding"):
    v = F.col(vector)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & plain & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(vecs: DataFrame) -> DataFrame:
    """vec_id, embedding and 128 bits of hash by which equal vectors are known."""
    v = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})


def near_vectors(vecs: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """Every row with n_links (other rows linked directly), component_id (smallest vec_id reachable) and kept.

    Equal vectors (128 bits of hash) are put together first, so copies cost one row; they link with each other. Tiles of
    distinct vectors (``tile`` of them; by default a bounded number of bytes) are dealt out as tile pairs; a pair returns a
    count per vector and a spanning forest, so output stays linear in the vectors however many pairs link. Vectors that
    are null, zero or hold null or non-finite components, and vectors of different lengths, link with nothing. A null
    vec_id isn't kept, and its component is the smallest vec_id it reaches, if any; rows that repeat a vec_id count as vectors of
    their own. Labels and other columns are ignored; an empty table gives no rows."""
    v = _rows(vecs)
    ok = v.where(valid())
    reps = saved(ok.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
                 .withColumn("dim", F.size("embedding").cast("long")), "vectors")
    coded = saved(_coded(reps, tile), "vector-codes")
    sure = saved(_tile_products(coded, threshold), "vector-links")
    links = sure.select("kind", "a", "b").unionByName(saved(_recomputed(coded, sure, threshold), "vector-links-near"))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("c_id")).agg(F.sum("b").alias("found"))
    comp = connected_components(links.where("kind = 1").select("a", "b")).withColumnRenamed("id", "k_id")
    named = (coded.select("id", "h1", "h2", "low", "copies").join(counts, F.col("id") == F.col("c_id"), "left")
             .join(comp, F.col("id") == F.col("k_id"), "left").withColumn("component", F.coalesce("component_id", "id")))
    real = named.groupBy("component").agg(F.min("low").alias("real_id"))
    named = (named.drop("component_id").join(real, "component")
             .select("h1", "h2", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("real_id").alias("component_id")))
    linked = ok.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _coded(reps: DataFrame, tile: int | None) -> DataFrame:
    """``reps`` with id, tile, tiles (of its length) and the int8 codes beside the vector."""
    n = F.col("rows_of_dim")
    rows = F.lit(tile).cast("long") if tile else F.greatest(F.lit(1), F.least(
        F.floor(F.lit(TILE_BYTES) / F.col("dim")), F.greatest(F.lit(LEAST_ROWS), F.ceil(n / LEAST_TILES))))
    sizes = (reps.groupBy("dim").agg(F.count(F.lit(1)).alias("rows_of_dim"))
             .select(F.col("dim").alias("s_dim"), rows.cast("long").alias("tile_rows"), n))
    at = (numbered(reps, ["dim"], ["h1", "h2"]).join(sizes, F.col("dim") == F.col("s_dim"))
          .select((F.col("dim") * F.lit(1 << 40) + F.col("slot")).alias("id"), "h1", "h2", "low", "copies", "dim", "embedding",
                  F.expr("slot div tile_rows").alias("tile"), F.expr("(rows_of_dim + tile_rows - 1) div tile_rows").alias("tiles")))

    def code(batches):
        for t in batches:
            vectors, dims = t.column("embedding"), t.column("dim").to_numpy()
            codes = [b""] * len(dims)
            scale, near, error = (np.zeros(len(dims), np.float32) for _ in range(3))
            for dim in np.unique(dims):
                m = np.flatnonzero(dims == dim)
                x = plain(vectors.take(pa.array(m)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                q, scale[m], near[m], error[m] = quantise(x / lengths(x)[:, None])
                for k, row in zip(m.tolist(), q):
                    codes[k] = row.tobytes()
            extra = [pa.array(codes, pa.binary()), *map(pa.array, (scale, near, error))]
            yield pa.RecordBatch.from_arrays([*t.columns, *extra], names=[*t.schema.names, "codes", "scale", "near", "error"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema)
    return at.mapInArrow(code, f"{fields}, codes binary, scale float, near float, error float")


def _as_tile(t: pa.Table, dim: int) -> Tile:
    """Rows of the code table, in the order of their ids."""
    t = t.sort_by("id")
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int8).reshape(-1, dim)
    return Tile(*(t[c].to_numpy() for c in ("id", "copies")), codes, *(t[c].to_numpy() for c in ("scale", "near", "error")))


PACKED = [("copies", np.int64), ("codes", np.int8), ("scale", np.float32), ("near", np.float32), ("error", np.float32)]


def _tile_products(coded: DataFrame, threshold: float) -> DataFrame:
    """``(kind, dim, ti, tj, a, b)``. Kind 0: a vector and the number of rows it links to for sure; 1: an edge of a forest
    of sure links; 2: a vector that the tile pair must see in full."""
    def pack(key, t):
        tile = _as_tile(t, key[0].as_py())
        arrays = {"copies": tile.copies, "codes": tile.codes, "scale": tile.scale, "near": tile.near, "error": tile.error}
        return pa.table({"dim": [key[0].as_py()], "tile": [key[1].as_py()], "tiles": t["tiles"][:1].to_pylist(), "first": [int(tile.ids[0])],
                         **{c: pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in PACKED}})

    # ids of a tile are gapless, so the first one tells them all; one row a tile
    packed = saved(coded.select("id", "dim", "tile", "tiles", "copies", "codes", "scale", "near", "error").groupBy("dim", "tile").applyInArrow(
        pack, "dim long, tile long, tiles long, first long, copies binary, codes binary, scale binary, near binary, error binary"), "vector-tiles")
    # each tile goes once to every tile pair it is in: equality on the pair, no join of all rows with all
    sent = (packed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
            .select("dim", F.least("tile", "k").alias("ti"), F.greatest("tile", "k").alias("tj"), "tile", "first", *[c for c, _ in PACKED]))

    def run(key, t):
        dim, ti, tj = (k.as_py() for k in key)

        def unpack(n):
            r = t.slice(t["tile"].to_pylist().index(n), 1).to_pylist()[0]
            copies, codes, *rest = (np.frombuffer(r[c], kind) for c, kind in PACKED)
            return Tile(r["first"] + np.arange(len(copies)), copies, codes.reshape(-1, dim), *rest)
        a = unpack(ti)
        return _found(key, a, a if ti == tj else unpack(tj), threshold, None)

    # tile pairs are heavy on CPU and light on bytes: one task each (up to a bound), whatever their size
    n = packed.where("tile = 0").agg(F.sum(F.expr("tiles * (tiles + 1) div 2"))).first()[0] or 1
    return sent.repartition(max(1, min(n, MOST_TASKS)), "dim", "ti", "tj").groupBy("dim", "ti", "tj").applyInArrow(run, LINKS)


LINKS = "kind int, dim long, ti long, tj long, a long, b long"


def _found(key, a: Tile, b: Tile, threshold: float, cosine) -> pa.Table:
    """Links of a tile pair: the sure ones and the rows of the open ones (no ``cosine``), or the open ones by it."""
    dim, ti, tj = (k.as_py() for k in key)
    same, n = a is b, len(a.ids)
    ids, copies = (a.ids, a.copies) if same else (np.concatenate((a.ids, b.ids)), np.concatenate((a.copies, b.copies)))
    links, needed = Forest(copies), np.zeros(len(ids), bool)
    for i, j, sure in tile_pairs(a, b, threshold, same):
        jj = j if same else j + n
        if cosine is None:
            needed[i[~sure]] = needed[jj[~sure]] = True
            links.add(i[sure], jj[sure])
            continue
        i, j, jj = i[~sure], j[~sure], jj[~sure]
        for s in range(0, len(i), 65536):
            z = slice(s, s + 65536)
            hit = cosine(i[z], j[z]) >= threshold
            links.add(i[z][hit], jj[z][hit])
    kind, left, right = links.rows(ids)
    more = ids[needed]
    kind = np.concatenate((kind, np.full(len(more), 2, np.int32)))
    left, right = np.concatenate((left, more)), np.concatenate((right, more))
    key = {c: pa.array(np.full(len(kind), x, np.int64)) for c, x in (("dim", dim), ("ti", ti), ("tj", tj))}
    return pa.table({"kind": pa.array(kind), **key, "a": pa.array(left.astype(np.int64)), "b": pa.array(right.astype(np.int64))})


def _recomputed(coded: DataFrame, sure: DataFrame, threshold: float) -> DataFrame:
    """``(kind, a, b)`` of the pairs between the bounds: their vectors are fetched once a tile pair, the stored codes tell
    the same pairs again, and the cosine is computed in double precision."""
    need = sure.where("kind = 2").select("ti", "tj", F.col("a").alias("n_id"))
    rows = need.join(coded.drop("h1", "h2", "low", "tiles"), F.col("n_id") == F.col("id")).drop("n_id")

    def run(key, t):
        dim, ti, tj = (k.as_py() for k in key)

        def part(n):
            own = t.filter(pc.equal(t["tile"], n)).sort_by("id")
            x = plain(own["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            return _as_tile(own, dim), x, lengths(x)
        a, x, nx = part(ti)
        b, y, ny = (a, x, nx) if ti == tj else part(tj)
        # cosine as dot / (|x| |y|)
        return _found(key, a, b, threshold, lambda i, j: np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])).select(["kind", "a", "b"])

    return rows.groupBy("dim", "ti", "tj").applyInArrow(run, "kind int, a long, b long")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
