"""Quality classifier: interpolated modified Kneser-Ney over character 4-grams of trusted text.

N-gram counts, context totals and continuation counts are Spark tables keyed (sharded) by n-gram and joined on
the context to give every seen n-gram its discounted probability and every context its back-off weight. Every character of
trusted text is a symbol of its own. The seen n-grams are sent to the tasks as arrays, and a document's perplexity is an
in-task lookup per character: whole texts are never shuffled. Windows of the ``ALPHABET`` most frequent symbols are looked up
in a table of their contexts, those with a rarer one by search among the seen n-grams.

Two models are fitted, each without the trusted documents of one fold (by hash of doc_id), and a document is scored by the
model that did not learn from its fold. So the quantiles of trusted scores are those of unseen text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import doc_bucket, sample_ids, saved, table

ALPHABET = 64              # most frequent symbols, whose contexts have a table; 0 is the start, 1 any character that trusted text lacks
ORDER = 4
PRIOR = 60                 # characters' worth of the language's mean mixed into every score: short texts vary
COUNTED = 1 << 20          # characters whose n-grams a task sorts at once
HIGH, LOW = 0.995, 0.005   # quantiles of trusted scores per language
REACH = 2                  # a bound lies this many times as far from the language's median as its quantile
FOLDS = 2
BITS = 1 << 26            # bitmap of trusted ids: 8 MB whatever their number


def symbols(text: str, folded: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return folded[np.minimum(cp, len(folded) - 1)]


def size_of(folded: np.ndarray) -> int:
    """Number of symbols, ``ALPHABET`` at least: the uniform share that every symbol has is one in so many."""
    return max(ALPHABET, int(folded.max()) + 1)


def windows(sym: np.ndarray) -> list[np.ndarray]:
    """The last ``ORDER`` symbols at every character, oldest first; the text starts after three start symbols."""
    s = np.concatenate((np.zeros(ORDER - 1, np.int64), sym.astype(np.int64)))
    return [s[i:i + len(sym)] for i in range(ORDER)]


def contexts(window: list[np.ndarray], size: int) -> np.ndarray:
    """Number of the symbols before the last one; at most three of at most 2**21, so 63 bits hold it."""
    h = np.zeros(len(window[-1]), np.int64)
    for s in window[:-1]:
        h = h * size + s
    return h


def numbers(h: np.ndarray, w: np.ndarray, order: int, size: int) -> np.ndarray:
    """Number of the n-gram ``w`` after ``h``; where 63 bits don't hold it (more than 55,108 symbols), its halves as a complex number,
    which sorts alike."""
    if size ** order < 1 << 63:
        return h * size + w
    return (h // size) + 1j * (h % size * size + w)


def parted(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and last symbol of n-gram numbers."""
    if not np.iscomplexobj(g):
        return g // size, g % size
    low = g.imag.astype(np.int64)
    return g.real.astype(np.int64) * size + low // size, low % size


def grams(sym: np.ndarray, size: int = ALPHABET) -> np.ndarray:
    """4-gram number at every character."""
    window = windows(sym)
    return numbers(contexts(window, size), window[-1], ORDER, size)


def added_up(parts: Iterator[np.ndarray], most: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of all ``parts`` and their counts. About ``most`` numbers (or one part) are held beside the distinct ones,
    however many there are in all."""
    known, counts, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        g, c = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate((known, g)), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        total[at[:len(known)]] = counts
        total[at[len(known):]] += c
        return both, total

    for part in parts:
        held.append(part)
        n += len(part)
        if n >= most:
            known, counts = merged()
            held, n = [], 0
    return merged() if held else (known, counts)


def _alphabet(trusted: DataFrame, most: int | None = None) -> np.ndarray:
    """Code point -> symbol (1 is 'any other'): every character of the trusted texts, by frequency; given ``most``, so many symbols."""
    def count(batches):
        for b in batches:
            total: dict[int, int] = {}
            for t in b.column(0):
                cp, n = np.unique(np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
                for c, k in zip(cp.tolist(), n.tolist()):
                    total[c] = total.get(c, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cp", "n"])

    # at most a row a code point
    seen = trusted.select("text").mapInArrow(count, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n")).toArrow()
    cp, n = seen["cp"].to_numpy(), seen["n"].to_numpy()
    top = cp[np.lexsort((cp, -n))][:None if most is None else most - 2]
    folded = np.ones(0x110000, dtype=np.min_scalar_type(len(top) + 1))
    folded[top] = np.arange(2, len(top) + 2)
    return folded


def _gram_counts(trusted: DataFrame, folded: np.ndarray) -> DataFrame:
    """``(fold, h, w, c)``: n-grams, as context and last symbol, counted by the fold of their document."""
    shared, size = trusted.sparkSession.sparkContext.broadcast(folded), size_of(folded)

    def counted(texts):
        return added_up(grams(symbols(t, shared.value), size) for t in texts if t)

    def count(batches):
        for b in batches:
            folds = b.column(1).to_numpy()
            for fold in np.unique(folds).tolist():
                g, n = counted(b.column(0)[i].as_py() for i in np.flatnonzero(folds == fold))
                h, w = parted(g, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), fold), pa.int32()), pa.array(h, pa.int64()), pa.array(w, pa.int32()),
                                                  pa.array(n, pa.int64())], names=["fold", "h", "w", "c"])

    counts = trusted.select("text", "fold").mapInArrow(count, "fold int, h long, w int, c long")
    return counts.groupBy("fold", "h", "w").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, size: int = ALPHABET) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order 4..1: ``(h, w, disc)``, the discounted share of a seen n-gram in its context, and ``(h, gamma)``, the
    context's back-off weight. Lower orders use continuation counts (distinct symbols in front). The three discounts
    of an order come from its counts of counts (Chen and Goodman)."""
    seen, back, level = [], [], counts
    for order in range(ORDER, 0, -1):
        n = {r["c"]: r["n"] for r in level.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d1 = max(0.05, 1 - 2 * y * n2 / n1) if n1 else 0.5
        d2 = min(1.9, max(0.1, 2 - 3 * y * n3 / n2)) if n2 else 1.0
        d3 = min(2.9, max(0.15, 3 - 4 * y * n4 / n3)) if n3 else 1.5
        cut = F.when(F.col("c") == 1, F.lit(d1)).when(F.col("c") == 2, F.lit(d2)).otherwise(F.lit(d3))
        context = level.groupBy("h").agg(F.sum("c").alias("total"), F.sum(cut).alias("kept"))
        seen.append(level.join(context, "h").select("h", "w", ((F.col("c") - cut) / F.col("total")).alias("disc")))
        back.append(context.select("h", (F.col("kept") / F.col("total")).alias("gamma")))
        if order > 1:
            level = level.groupBy(F.expr(f"h % {size ** (order - 2)}L").alias("h"), "w").agg(F.count(F.lit(1)).alias("c"))
            level = saved(level, "continuations")
    return seen, back


def _common(seen: list[tuple[np.ndarray, np.ndarray]], back: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[list, list]:
    """Of the n-grams and contexts those of the ``ALPHABET`` most frequent symbols, by their numbers in that alphabet alone."""
    if size == ALPHABET:
        return seen, back

    def kept(number, values, length):
        digits = []
        if np.iscomplexobj(number):
            number, last = parted(number, size)
            digits.append(last)
        while len(digits) < length:
            digits.append(number % size)
            number = number // size
        own, number = np.ones(len(values), bool), np.zeros(len(values), np.int64)
        for d in reversed(digits):
            own &= d < ALPHABET
            number = number * ALPHABET + d
        return number[own], values[own]

    return ([kept(g, v, ORDER - k) for k, (g, v) in enumerate(seen)], [kept(h, v, ORDER - k - 1) for k, (h, v) in enumerate(back)])


def compact(seen: list[tuple[np.ndarray, np.ndarray]], back: list[tuple[np.ndarray, np.ndarray]], size: int = ALPHABET) -> tuple[np.ndarray, np.ndarray]:
    """``(start, logp)``: log10 P (float32) of symbol w after context h is ``logp[start[h] + w]``, for the ``ALPHABET`` most frequent
    symbols of ``size``. From order 1 up, P(w|h) = disc + gamma(h) * P(w|shorter h). A context that trusted text lacks shares the
    row of its shorter one, so the table grows with the contexts seen and not with ALPHABET**4."""
    seen, back = _common(seen, back, size)
    p = np.full(ALPHABET, 1.0 / size, dtype=np.float32)
    for order in range(1, ORDER):
        (g, disc), (h, gamma) = seen[ORDER - order], back[ORDER - order]
        weight = np.ones(ALPHABET ** (order - 1), dtype=np.float32)
        weight[h] = gamma
        p = (p if order == 1 else np.tile(p, ALPHABET)).reshape(-1, ALPHABET)
        p *= weight[:, None]
        p = p.reshape(-1)
        p[g] += disc.astype(np.float32)      # every n-gram is there once
    (g, disc), (h, gamma) = seen[0], back[0]
    short = p.reshape(-1, ALPHABET)
    logp = np.empty((len(short) + len(h), ALPHABET), dtype=np.float32)
    logp[:len(short)] = short
    np.multiply(short[h % len(short)], gamma.astype(np.float32)[:, None], out=logp[len(short):])
    start = np.tile(np.arange(len(short), dtype=np.int32), ALPHABET)
    start[h] = len(short) + np.arange(len(h), dtype=np.int32)
    start *= ALPHABET
    logp = logp.reshape(-1)
    logp[start[g // ALPHABET] + g % ALPHABET] += disc.astype(np.float32)
    np.maximum(logp, np.float32(1e-12), out=logp)
    return start, np.log10(logp, out=logp)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sorted ``keys`` have each wanted one, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def searched(seen: list[tuple[np.ndarray, np.ndarray]], back: list[tuple[np.ndarray, np.ndarray]], size: int):
    """log10 P of the last symbols of any windows, from n-grams and contexts sorted by number: the probability of the longest seen
    n-gram, times the weights of the contexts it was backed off from."""
    p = {}
    for order in range(1, ORDER + 1):
        (g, disc), (h, gamma) = seen[ORDER - order], back[ORDER - order]
        before, w = parted(g, size)
        lower = np.float32(1.0 / size)
        if order > 1:       # what follows a seen context was seen after the shorter one
            lower = p[order - 1][_found(seen[ORDER - order + 1][0], numbers(before % size ** (order - 2), w, order - 1, size))[1]]
        p[order] = disc + gamma[_found(h, before)[1]] * lower

    def score(window: list[np.ndarray]) -> np.ndarray:
        out, weight, open_ = np.empty(len(window[-1])), np.ones(len(window[-1])), np.arange(len(window[-1]))
        for order in range(ORDER, 0, -1):
            tail = [s[open_] for s in window[ORDER - order:]]
            h = contexts(tail, size)
            hit, at = _found(seen[ORDER - order][0], numbers(h, tail[-1], order, size))
            out[open_[hit]] = p[order][at[hit]]
            open_, h = open_[~hit], h[~hit]
            known, at = _found(back[ORDER - order][0], h)
            weight[open_[known]] *= back[ORDER - order][1][at[known]]
        out[open_] = 1.0 / size
        return np.log10(np.maximum(out * weight, 1e-12))

    return score


class Model:
    """Trained n-gram model: the seen n-grams as a broadcast; tasks build the table of the seen frequent contexts once each. Made from
    texts directly it has ``most`` symbols (null: a symbol for every character, as the models of ``cross_fitted``)."""

    def __init__(self, spark: SparkSession, trusted: DataFrame, most: int | None = ALPHABET):
        folded = _alphabet(trusted, most)
        self._build(spark, folded, _gram_counts(trusted.withColumn("fold", F.lit(0)), folded).drop("fold"))

    @classmethod
    def of_counts(cls, spark: SparkSession, folded: np.ndarray, counts: DataFrame) -> Model:
        model = cls.__new__(cls)
        model._build(spark, folded, counts)
        return model

    def _build(self, spark: SparkSession, folded: np.ndarray, counts: DataFrame) -> None:
        size = size_of(folded)
        seen, back = kneser_ney(saved(counts, "grams"), size)

        def arrays(df, order, value):
            """Numbers in order, and values. The n-grams that trusted text has, 12 bytes each."""
            t = df.withColumn(value, F.col(value).cast("float")).toArrow()
            g = t["h"].to_numpy().astype(np.int64)
            if "w" in t.column_names:
                g = numbers(g, t["w"].to_numpy().astype(np.int64), order, size)
            at = np.argsort(g)
            return g[at], t[value].to_numpy()[at]

        self.parts = spark.sparkContext.broadcast(
            (folded, [arrays(d, ORDER - k, "disc") for k, d in enumerate(seen)], [arrays(d, ORDER - k, "gamma") for k, d in enumerate(back)]))

    def scorer(self):
        parts, ready = self.parts, []

        def score(text: str | None) -> tuple[float, int]:
            """Sum of log10 P over the characters of the whole text, and their number."""
            if not ready:
                folded, seen, back = parts.value
                size = size_of(folded)
                ready.append((folded, *compact(seen, back, size), searched(seen, back, size) if size > ALPHABET else None))
            folded, start, logp, search = ready[0]
            total, n = 0.0, len(text) if text else 0
            for at in range(0, n, 1 << 18):                 # long texts in windows that overlap by the context
                part = symbols(text[max(0, at - ORDER + 1):at + (1 << 18)], folded)
                new = min(at, ORDER - 1)
                rare = part >= ALPHABET
                if rare.any():
                    window = [s[new:] for s in windows(part)]
                    rare = np.logical_or.reduce([s >= ALPHABET for s in window])
                    total += float(search([s[rare] for s in window]).sum())
                    g = grams(part)[new:][~rare]
                else:
                    g = grams(part)[new:]
                total += float(logp[start[g // ALPHABET] + g % ALPHABET].sum(dtype=np.float64))
            return total, n
        return score


def fold_of() -> Column:
    """The fold of a document, by hash of its id; 0 for a null id."""
    return F.coalesce(doc_bucket(FOLDS), F.lit(0)).cast("int")


def cross_fitted(trusted: DataFrame) -> list[Model]:
    """For every fold the model of the trusted documents of the other folds; the n-grams are counted once."""
    spark = trusted.sparkSession
    folded = _alphabet(trusted)
    counts = saved(_gram_counts(trusted, folded), "fold-grams")
    return [Model.of_counts(spark, folded, counts.where(F.col("fold") != k).groupBy("h", "w").agg(F.sum("c").alias("c"))) for k in range(FOLDS)]


def _bits(ids: DataFrame, name: str) -> DataFrame:
    """``(word, mask)``: a bitmap of ``BITS`` bits, those set to which an id (column ``t_id``) hashes. BITS / 64 rows at most, however
    many ids there are: the bound that makes a broadcast of it safe."""
    at = _bit("t_id")
    words = ids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("mask"))
    return F.broadcast(saved(words, name))


def _bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(BITS))


def _marked(docs: DataFrame, bits: DataFrame, doc_id: str = "doc_id", within: bool = True) -> DataFrame:
    """The rows whose bit is set (``within``) or those of which it is not; the rows stay where they are."""
    at = _bit(doc_id)
    b = bits.select(F.col("word").alias("__word"), F.col("mask").alias("__mask"))
    mine = F.call_function("shiftright", F.coalesce("__mask", F.lit(0).cast("long")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.join(b, F.shiftright(at, 6) == F.col("__word"), "inner" if within else "left").where(mine if within else ~mine).drop("__word", "__mask")


def trusted_documents(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts of all documents that carry label quality 1 and not toxic 1; given a ``limit``, of that many chosen by hash of the id.

    Texts stay where they are read: a document is told by the bit of its id. Only ids are joined with the labels to find the bits
    that trusted documents share with others (some BITS to the number of ids), and only texts of these bits are shuffled."""
    good = labels.where((F.col("quality") == 1) & ~(F.coalesce(F.col("toxic"), F.lit(0)) == 1))
    ids = sample_ids(good, limit) if limit is not None else good.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    ids = saved(ids.withColumnRenamed("doc_id", "t_id"), "trusted-ids")
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    bits = _bits(ids, "trusted-bits")
    others = _marked(known.select("doc_id"), bits).join(ids, F.col("doc_id") == F.col("t_id"), "left_anti")
    shared = _bits(others.withColumnRenamed("doc_id", "t_id"), "shared-bits")
    own = _marked(known, bits)
    sure = _marked(own, shared, within=False)
    # written before the join: Spark would push the semi-join below the filter and shuffle every text
    open_ = saved(_marked(own, shared), "shared-texts").join(_marked(ids, shared, "t_id"), F.col("doc_id") == F.col("t_id"), "left_semi")
    return sure.unionByName(saved(open_, "open-texts")).select("text", fold_of().alias("fold"))


def scores(docs: DataFrame, models: list[Model]) -> DataFrame:
    """``(doc_id, lang, total, n)`` of every row, on whole texts, by the model of its fold."""
    score = [m.scorer() for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [score[k](t.as_py()) for t, k in zip(b.column(2), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())],
                names=["doc_id", "lang", "total", "n"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", fold_of().alias("fold"))
            .mapInArrow(run, "doc_id long, lang string, total double, n long"))


def thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Per language (null: all languages) the mean log10 P a character of all labelled trusted documents, and the
    bounds ``low``/``high``: ``REACH`` times as far from the median as the quantiles ``LOW`` and ``HIGH`` of their smoothed scores. One row per
    language."""
    good = labels.where((F.col("quality") == 1) & ~(F.coalesce(F.col("toxic"), F.lit(0)) == 1)).select(F.col("doc_id").alias("t_id")).distinct()
    t = scored.where("n > 0").join(good, F.col("doc_id") == F.col("t_id"), "left_semi")
    both = t.unionByName(t.where("lang is not null").withColumn("lang", F.lit(None).cast("string")))
    mean = saved(both.groupBy("lang").agg((F.sum("total") / F.sum("n")).alias("mean")), "kn-mean")
    smooth = (F.col("total") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    both = both.join(mean.withColumnRenamed("lang", "m_lang"), F.col("lang").eqNullSafe(F.col("m_lang")))
    q = F.percentile_approx(smooth, [LOW, 0.5, HIGH], 10_000)
    at = both.groupBy("lang").agg(F.first("mean").alias("mean"), q.alias("q"))
    return at.select("lang", "mean", *[(F.col("q")[1] + REACH * (F.col("q")[k] - F.col("q")[1])).alias(name) for k, name in ((0, "low"), (2, "high"))])


def fit(docs: DataFrame, labels: DataFrame, limit: int | None = None):
    """The models by fold, all scores and the thresholds (a row per language; null: languages without trusted documents)."""
    models = cross_fitted(trusted_documents(docs, labels, limit))
    scored = saved(scores(docs, models), "kn-scores")
    return models, scored, saved(thresholds(scored, labels), "kn-thresholds")


def judged(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """``scored`` with perplexity (a character; null for empty texts), its bounds and ``keep``.

    A document is rejected if its smoothed score leaves the bounds of its language on either side: above them it is as predictable as trusted text never is, below them as odd. Null and empty texts give no
    evidence and are kept, as is everything where there is no trusted text at all."""
    general = bounds.where("lang is null").first()      # one row: all languages
    if general is None:
        return scored.withColumns({"smoothed": F.lit(None).cast("double"), "keep": F.lit(True),
                                   "perplexity": F.when(F.col("n") > 0, F.pow(F.lit(10.0), -F.col("total") / F.col("n")))})
    own = bounds.where("lang is not null").select(F.col("lang").alias("b_lang"), F.struct("mean", "low", "high").alias("b"))
    d = scored.join(F.broadcast(own), F.col("lang") == F.col("b_lang"), "left")
    b = F.coalesce("b", F.struct(*[F.lit(general[k]).alias(k) for k in ("mean", "low", "high")]))
    smooth = (F.col("total") + PRIOR * b["mean"]) / (F.col("n") + PRIOR)
    keep = (F.col("n") == 0) | smooth.between(b["low"], b["high"])
    return d.withColumns({"smoothed": smooth, "keep": F.coalesce(keep, F.lit(True)),
                          "perplexity": F.when(F.col("n") > 0, F.pow(F.lit(10.0), -F.col("total") / F.col("n")))}).drop("b", "b_lang")


def quality(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, score (smoothed log10 P a character) and keep, of every row.

    Repeated rows get equal verdicts; null languages use the bounds of all languages; extra columns are ignored; an
    empty table gives no rows."""
    _, scored, bounds = fit(docs, labels, limit)
    return judged(scored, bounds).select("doc_id", "lang", F.col("n").alias("n_chars"), "perplexity", F.col("smoothed").alias("score"), "keep")


def keep_quality(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """``docs`` without the rejected ones, all columns kept. Texts are scored again in place rather than joined to
    their verdicts, so they are not shuffled; both passes give the same score."""
    models, _, bounds = fit(docs, labels, limit)
    score = [m.scorer() for m in models]

    @F.arrow_udf("struct<total:double,n:long>")
    def scored(texts: pa.Array, folds: pa.Array) -> pa.Array:
        got = [score[k](t.as_py()) for t, k in zip(texts, folds.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())], names=["total", "n"])

    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("lang").cast("string").alias("lang"),
                      scored.asNondeterministic()("text", fold_of()).alias("s")).select("row", "lang", "s.total", "s.n")
    return judged(own, bounds).where("keep").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op3_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
