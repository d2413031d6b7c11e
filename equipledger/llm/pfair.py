"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source of weight w (of 1) is owed w blocks a slot. Its j-th block is released at floor(j/w) and due at ceil((j+1)/w);
earliest deadline first over released blocks gives every slot one block and keeps every source within less than one
block of w times the slots at every slot, however many there are. Weights are whole numbers of ``UNITS``, so release
times and deadlines are exact. The fold takes one step a block; it runs once for the state at every ``CHUNK``-th block
and once more, chunk by chunk in tasks of their own, for the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.llm.common import numbered, saved, table

UNITS = 10 ** 12             # weights are told apart to 1/UNITS: a block in 2 * UNITS slots
CHUNK = 512                  # blocks that one task puts in order
BLOCK_BYTES = 64 * 1024
TEMPERATURE = 0.7            # default target: bytes of a source to this power


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def shares(totals: DataFrame, weights: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """``(src, bytes)`` -> ``(src, bytes, m)``: the weight in whole units, one at least for a weight above 0. One row per
    source, so the window here runs over the recipe, not over documents."""
    if weights is None:
        w = F.pow(F.col("bytes").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("n" if k is None else f"s{k}"), F.lit(float(v)))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("src")) if pairs else F.lit(None).cast("double"), F.lit(0.0))
    t = totals.withColumn("w", F.greatest(w, F.lit(0.0)))
    unit = F.nullif(F.sum("w").over(Window.partitionBy(F.lit(0))), F.lit(0.0)) / UNITS
    m = F.when(F.col("w") > 0, F.greatest(F.lit(1), F.round(F.col("w") / unit))).otherwise(0)
    return t.withColumn("m", m.cast("long")).select("src", "bytes", "m")


def _over(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _step(state: Column, q: Column) -> Column:
    """One block: the state's sources (m, blocks left, lag = units owed less units had) and slot t, moved to the next
    slot in which a source has a block released, with that block (earliest deadline first, then by name) as ``got``."""
    def wait(x):
        return F.when(x["left"] > 0, F.greatest(F.lit(0).cast("long"), _over(-x["lag"], x["m"])))

    def offer(x, i, gone):
        due = _over(q - x["lag"] - x["m"] * gone + x["m"] - 1, x["m"])
        return F.when(wait(x) <= gone, F.struct(due.alias("due"), i.alias("i"), x["had"].alias("had")))

    def one(gone):
        first = F.array_min(F.transform(state["s"], lambda x, i: offer(x, i, gone)))

        def moved(first):
            s = F.transform(state["s"], lambda x, i: F.struct(
                x["m"].alias("m"), (x["left"] - (i == first["i"]).cast("long")).alias("left"),
                F.when(x["left"] > 0, x["lag"] + x["m"] * (gone + 1) - F.when(i == first["i"], q).otherwise(F.lit(0).cast("long")))
                .otherwise(x["lag"]).alias("lag"), (x["had"] + (i == first["i"]).cast("long")).alias("had")))
            return F.struct((state["t"] + gone + 1).alias("t"), s.alias("s"),
                            F.struct(first["i"].alias("i"), first["had"].alias("k"), (state["t"] + gone).alias("slot")).alias("got"))
        return _let(first, moved)
    return _let(F.array_min(F.transform(state["s"], wait)), one)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` reckoned once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def order_of(recipe: DataFrame) -> DataFrame:
    """``(src, m, blocks)`` -> ``(src, k, slot, release, deadline)`` of every block of the sources with m > 0. Sources that
    have run out are passed over; a slot in which no other has a block released stays empty."""
    long, none = (lambda n: F.lit(n).cast("long")), F.struct(*[F.lit(0).cast(t).alias(n) for n, t in (("i", "int"), ("k", "long"), ("slot", "long"))])
    r = recipe.where("m > 0 and blocks > 0").groupBy().agg(
        F.sort_array(F.collect_list(F.struct("src", F.col("m").cast("long").alias("m"), F.col("blocks").cast("long").alias("blocks")))).alias("all"))
    r = r.join(recipe.groupBy().agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("q")), how="cross").where(F.size("all") > 0)
    r = r.withColumn("n", F.aggregate("all", long(0), lambda a, x: a + x["blocks"]))
    s = F.transform("all", lambda x: F.struct(x["m"].alias("m"), x["blocks"].alias("left"), long(0).alias("lag"), long(0).alias("had")))
    start = F.struct(long(0).alias("t"), s.alias("s"), none.alias("got"))
    q, n = F.col("q"), F.col("n")

    def steps(c):
        return F.sequence(long(1), F.least(long(CHUNK), n - c * CHUNK))

    def chunk(a, c):
        after = F.aggregate(steps(c), a["at"], lambda st, _: _step(st, q))
        return F.struct(after.alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))

    r = r.withColumn("start", start)
    starts = F.aggregate(F.sequence(long(0), _over(n - 1, long(CHUNK))), F.struct(F.col("start").alias("at"), F.slice(F.array("start"), 1, 0).alias("starts")),
                         chunk)["starts"]
    r = r.select("all", "q", "n", F.posexplode(starts).alias("c", "at")).repartition("c")
    first = F.struct(F.col("at"), F.slice(F.array(F.col("at.got")), 1, 0).alias("out"))

    def put(a, _):
        return _let(_step(a["at"], q), lambda st: F.struct(st.alias("at"), F.concat(a["out"], F.array(st["got"])).alias("out")))

    out = r.select("all", "q", F.explode(F.aggregate(steps(F.col("c").cast("long")), first, put)["out"]).alias("b"))
    m = F.get("all", F.col("b.i"))["m"]
    wide = F.col("b.k").cast("decimal(19,0)")
    big = q.cast("decimal(18,0)")
    return out.select(F.get("all", F.col("b.i"))["src"].alias("src"), F.col("b.k").alias("k"), F.col("b.slot").alias("slot"),
                      _over(wide * big, m.cast("decimal(18,0)")).cast("long").alias("release"),
                      _over((wide + 1) * big + m - 1, m.cast("decimal(18,0)")).cast("long").alias("deadline"))


def cycle_order(sharing: DataFrame) -> DataFrame:
    """``(src, m)`` -> ``(src, at)``: the slots a source gets of sum(m) slots, by earliest deadline first."""
    return order_of(sharing.withColumn("blocks", F.col("m"))).groupBy("src").agg(F.sort_array(F.collect_list("slot")).alias("at"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES,
             temperature: float = TEMPERATURE, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (as struct ``row``: all columns or those of ``keep``) with mix_bytes, mix_block, mix_release, mix_deadline, mix_slot, mix_offset and mix_full; order by mix_slot, then
    mix_offset. All rows and columns stay; nothing is repeated.

    A source's documents, in hashed order, are cut into blocks of ``block_bytes`` (a longer document stands at its
    first block, whose slots after it stay empty). mix_full is true as long as every source with a weight still has
    blocks: up to there the shares are within one block of their weights; after it the sources left go on in their own
    windows. Sources that ``weights`` doesn't name (or with weight 0) have null slots and come last. A null source is a
    source. Equal rows may swap places; an empty table gives no rows."""
    own = docs.select(F.struct(*(keep or docs.columns)).alias("row"), _key().alias("src"),
                      (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                      F.xxhash64("doc_id", "text").alias("h"))
    totals = own.groupBy("src").agg(F.sum("size").alias("bytes"))
    recipe = saved(shares(totals, weights, temperature)
                   .withColumn("blocks", F.floor((F.col("bytes") - 1) / block_bytes) + 1), "recipe")
    # one row a block; small beside the texts, so Spark broadcasts it up to its threshold
    blocks = saved(order_of(recipe).select(F.col("src").alias("b_src"), F.col("k").alias("b_k"), "slot", "release", "deadline")
                   .withColumnRenamed("slot", "b_slot"), "blocks")
    until = blocks.groupBy("b_src").agg(F.max("b_slot").alias("last")).agg(F.min("last")).first()[0]
    d = numbered(own, ["src"], ["h"], "size").withColumn("k", F.floor(F.col("before") / block_bytes))
    d = d.join(blocks, (F.col("src") == F.col("b_src")) & (F.col("k") == F.col("b_k")), "left")
    return d.select(
        "row", F.col("size").alias("mix_bytes"), F.col("k").alias("mix_block"), F.col("release").alias("mix_release"),
        F.col("deadline").alias("mix_deadline"), F.col("b_slot").alias("mix_slot"), F.col("before").alias("mix_offset"),
        F.coalesce(F.col("b_slot") <= F.lit(until).cast("long"), F.lit(False)).alias("mix_full"))


MIX = ["mix_bytes", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset", "mix_full"]


def pfair_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the columns ``MIX`` (they replace columns of these names); see ``schedule``."""
    own = [c for c in options.get("keep") or docs.columns if c not in MIX]
    return schedule(docs, **options).select(*[F.col("row")[c].alias(c) for c in own], *MIX)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all rows and the same columns, in the order of the mix: files follow each other by slot."""
    last = F.col("mix_slot").asc_nulls_last()
    return (schedule(docs, **options).repartitionByRange(last).sortWithinPartitions(last, "mix_offset")
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pfair_mix(d, keep=["doc_id", "source"]).select("doc_id", "source", *MIX)
