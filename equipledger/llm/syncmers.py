"""Document fingerprints from closed syncmers, with DataFrame functions only.

The alphabet is words (long ones in pieces of ``PIECE`` characters). A k-mer of ``K`` words is an anchor if the
smallest hash of its inner ``S``-word substrings lies at its first or last place: this depends on the k-mer alone, so
equal passages give equal anchors wherever they stand. The fingerprint has all distinct anchors of the whole text;
likeness is the Jaccard index of two such sets. ``positions`` gives the anchors in order, repeats included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.llm.common import saved, table

K, S = 4, 2                # words of a k-mer and of its inner substrings; K - S must be 2
PIECE = 16
KEPT = None                # no anchor is left out of a fingerprint
CELLS = 128                # quantile cells of doc_id; each is cut evenly into buckets
ROWS_PER_BUCKET = 2_000


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the anchors of ``text`` in order (array of 32-bit values as longs). A text with words but without
    an anchor has one for all its words; null or blank text has none."""
    w, s = f"{out}__w", f"{out}__s"
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)),
                                      lambda x: F.xxhash64(x)))
    n = F.size(w)
    df = df.withColumn(s, F.when(n >= S, F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))),
                                                    lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    m = F.size(s)
    ends = F.zip_with(F.zip_with(s, F.slice(s, 2, F.greatest(m, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                      F.slice(s, 3, F.greatest(m, F.lit(1))),
                      lambda p, c: F.when((p["a"] <= F.least(p["b"], c)) | (c <= F.least(p["a"], p["b"])),
                                          F.when(c.isNotNull(), F.xxhash64(p["a"], c).bitwiseAND(F.lit(0xFFFFFFFF)))))
    df = df.withColumn(out, F.filter(ends, lambda x: x.isNotNull()))
    whole = F.array(F.xxhash64(w).bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn(out, F.when((F.size(out) == 0) & (F.size(w) > 0), whole).otherwise(F.col(out))).drop(w, s)


def sketch(anchors: str) -> Column:
    return F.sort_array(F.array_distinct(anchors))


def fingerprint(sketched: str) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two sets of anchors, 0 to 1; two empty ones are alike, an empty and another aren't."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def anchors(docs: DataFrame) -> DataFrame:
    """``(doc_id, position, anchor)`` for positional matching: every anchor of every whole text, by its order in it."""
    return with_anchors(docs.select("doc_id", "text"), "text", "anchors").select(
        "doc_id", F.posexplode("anchors").alias("position", "anchor"))


def _bucketed(docs: DataFrame) -> DataFrame:
    """Adds ``at`` (doc_id, nulls below all) and ``bucket``, which rises with it: quantile cells, each cut evenly."""
    d = docs.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                     F.percentile_approx("doc_id", [i / CELLS for i in range(1, CELLS)], 10_000).alias("q")).first()
    if not stats["n"] or stats["lo"] is None:
        return d.withColumn("bucket", F.lit(-1).cast("long"))
    edges = sorted({stats["lo"], *stats["q"]})
    subs = max(1, -(-stats["n"] // (ROWS_PER_BUCKET * len(edges))))
    widths = [max(1, -(-(b - a) // subs)) for a, b in zip(edges, [*edges[1:], stats["hi"] + 1])]
    e, w = F.array(*map(F.lit, edges)).cast("array<bigint>"), F.array(*map(F.lit, widths)).cast("array<bigint>")
    d = d.withColumn("cell", F.size(F.filter(e, lambda x: x <= F.col("doc_id"))) - 1)
    sub = F.floor((F.col("doc_id") - F.get(e, F.col("cell"))) / F.get(w, F.col("cell")))
    return d.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("cell") * subs + sub).cast("long")).drop("cell")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and its likeness to those of the edited text and of the
    next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; and positions,
    the anchors of the text in order (an anchor's index is its position).

    The next document is the next by doc_id (null ids first, ties by hash of the text), after the last the first; a
    single row is its own next. Texts move in one shuffle, by ranges of doc_id; the first row of every range is also
    looked up for the last row of the range before. Null texts count as empty; repeated rows all stay; extra
    columns are ignored; an empty table gives no rows."""
    d = _bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumn("tie", F.xxhash64("text"))
    firsts = d.groupBy("bucket").agg(F.min(F.struct("at", "tie")).alias("first"))
    # one row per bucket, a few thousandths of the documents
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(Window.partitionBy(F.lit(0)))))
    firsts = firsts.select(F.col("bucket").alias("f_bucket"), "before", F.col("first.at").alias("f_at"), F.col("first.tie").alias("f_tie"))
    firsts = saved(firsts, "first-rows")      # its size is known then: Spark broadcasts it as long as it is small
    heads = (d.join(firsts, (F.col("bucket") == F.col("f_bucket")) & (F.col("at") == F.col("f_at")) & (F.col("tie") == F.col("f_tie")))
             .select("before", F.col("text").alias("head_text")).dropDuplicates(["before"]))
    # anchors take as much room as the texts: they are reckoned after the shuffle, the next text's from that text
    w = Window.partitionBy("bucket").orderBy("at", "tie")
    own = d.withColumn("l_text", F.lead("text").over(w)).join(heads, F.col("bucket") == F.col("before"))
    own = own.withColumns({"n_text": F.coalesce("l_text", "head_text"), "n_chars": F.char_length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    own = own.select("doc_id", "n_chars", "text", "n_text",
                     F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut),
                              F.substring("n_text", F.lit(1), cut)).alias("edited"))
    own = with_anchors(with_anchors(with_anchors(own, "text", "positions"), "n_text", "n_anchors"), "edited", "e_anchors")
    own = own.withColumns({"own_set": sketch("positions"), "n_set": sketch("n_anchors"), "e_set": sketch("e_anchors")})
    return own.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      fingerprint("own_set").alias("fingerprint"), fingerprint("e_set").alias("edited_fingerprint"),
                      likeness("own_set", "e_set").alias("near_edited"), likeness("own_set", "n_set").alias("near_next"), "positions")


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
