"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches per language and source, then a
join of every document with the fences of its group.

A sketch is a histogram of non-negative whole numbers over log-linear buckets: values below 128 keep their own bucket, larger
ones keep their seven leading bits (relative error below 1/64). Sketches merge by adding counts, so partial aggregates
of any size and order give the same sketch, a hot source is summed where it lies, and the sketch of a language is the sum of
those of its sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.llm.common import saved, table

# fixed values of the base rules
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# rates in thousandths; each with the least spread that counts as one, so that a rate that is the same in most documents of a
# group does not turn a single odd word into an outlier
RATES = {"word_length": 400, "symbol_rate": 20, "dup_line_rate": 200, "repeat_rate": 120}
TWO_SIDED = ("word_length",)
FENCE = 3                # spreads beyond the quartiles
LEAST_GROUP = 30         # a group with fewer documents takes the sketch of its language, then of all
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word) of a whole text; null is empty."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        n, reached = Counter(windows), 0
        for i, w in enumerate(windows):
            if n[w] > 1:
                repeated += i + 3 - max(i, reached)
                reached = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the features, ``base_failed`` and the rates (thousandths) of every row of ``docs``."""
    names = [*FEATURES, "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(3)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols],
                                             names=["doc_id", "lang", "source", *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")), *(f"{c} long" for c in names)])
    d = docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    rate = lambda part, whole: F.expr("div(1000 * {}, {})".format(part, whole))
    d = d.withColumns({"__w": words, "__l": lines})
    return d.select(
        "doc_id", "lang", "source", *FEATURES,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        rate("word_chars", "__w").alias("word_length"), rate("n_symbols", "__w").alias("symbol_rate"),
        rate("n_dup_lines", "__l").alias("dup_line_rate"), rate("n_repeat_words", "__w").alias("repeat_rate"))


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket that holds a non-negative ``value``: its seven leading bits."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rates: DataFrame) -> DataFrame:
    """``(level, lang, source, rate, at, n)``: sketch rows per language and source (level 0), per language (1), of all (2)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("at")) for r in RATES])).alias("p")
    own = (rates.select("lang", "source", pairs).groupBy("lang", "source", F.col("p.rate").alias("rate"), F.col("p.at").alias("at"))
           .agg(F.count(F.lit(1)).alias("n")))
    own = saved(own, "sketches")
    nothing = F.lit(None).cast("string")

    def merged(level: int, keep: list[str]) -> DataFrame:
        return own.groupBy(*keep, "rate", "at").agg(F.sum("n").alias("n")).select(
            F.lit(level).alias("level"), *[(F.col(c) if c in keep else nothing).alias(c) for c in ("lang", "source")], "rate", "at", "n")

    return reduce(DataFrame.unionByName, [merged(0, ["lang", "source"]), merged(1, ["lang"]), merged(2, [])])


def quartiles(sketch: DataFrame) -> DataFrame:
    """``(level, lang, source, rate, n, q1, q3)``: q is the least bucket with at least that share of the rows up to it."""
    group = ["level", "lang", "source", "rate"]
    w = Window.partitionBy(*group)
    run = w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(w)})
    at = lambda part: F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("at")))
    return s.groupBy(*group).agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(rates: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Per language and source of ``rates`` one row with ``low_<rate>`` and ``high_<rate>``, taken from the narrowest sketch
    of at least ``least_group`` documents: its own, its language's, or that of all."""
    q = quartiles(sketches(rates))
    spread = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])[F.col("rate")]
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), spread)
    q = q.select("level", "lang", "source", "rate", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    q = q.groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{c}_{r}") for r in RATES for c in ("low", "high")])
    names = [f"{c}_{r}" for r in RATES for c in ("low", "high")]
    own = q.where("level = 0").select("lang", "source", F.struct("n", *names).alias("own"))
    lang = q.where("level = 1").select(F.col("lang").alias("__lang"), F.struct("n", *names).alias("by_lang"))
    whole = q.where("level = 2").select(F.struct("n", *names).alias("by_all"))
    f = own.join(lang, F.col("lang").eqNullSafe(F.col("__lang"))).join(whole, F.lit(True))  # one row
    use = (F.when(F.col("own.n") >= least_group, F.col("own")).when(F.col("by_lang.n") >= least_group, F.col("by_lang"))
           .otherwise(F.col("by_all")))
    return f.select("lang", "source", use.alias("u")).select("lang", "source", *[F.col(f"u.{n}").alias(n) for n in names])


def judged(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Every row of ``docs`` with its features, ``base_failed``, ``kept`` and ``broken`` (names of the adaptive rules it breaks).

    The sketches take the documents that pass the base rules. ``kept`` is false if a base rule fails or a rate lies
    beyond its fence: quartile plus or minus ``FENCE`` spreads. Null text is empty and fails the base rules; null language or
    source is a group like any other; repeated rows are judged row by row and count as often as they occur; ties fall on the
    kept side; an empty table gives no rows; extra columns are ignored."""
    m = saved(measured(docs), "measured")
    f = fences(m.where(~F.col("base_failed")), least_group).select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"{c}_{r}" for r in RATES for c in ("low", "high")])
    j = m.join(f, m["lang"].eqNullSafe(F.col("__lang")) & m["source"].eqNullSafe(F.col("__source")), "left")
    beyond = {r: (F.col(r) > F.col(f"high_{r}")) | (F.col(r) < F.col(f"low_{r}") if r in TWO_SIDED else F.lit(False)) for r in RATES}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in beyond.items()]))
    return j.select("doc_id", "lang", "source", *FEATURES, "base_failed", broken.alias("broken")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *FEATURES, "base_failed", "kept")


_RATE_ROWS = ", ".join(f"('{r}', {s})" for r, s in RATES.items())
_BEYOND = " OR ".join(
    f"(r.rate = '{r}' AND (r.v > f.high{' OR r.v < f.low' if r in TWO_SIDED else ''}))" for r in RATES)
ORACLE = rf"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM spots),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY row),
lines AS (SELECT row, count(*) AS n, count(DISTINCT line) AS k
          FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM words)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
counts AS (
  SELECT d.row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n - l.k, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM words d LEFT JOIN lines l ON d.row = l.row LEFT JOIN repeats r ON d.row = r.row),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
rates AS (
  SELECT row, lang, source, base_failed, unnest(['word_length', 'symbol_rate', 'dup_line_rate', 'repeat_rate']) AS rate,
         unnest([1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(n_words, 1),
                 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS v FROM base),
buckets AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS low_end
  FROM rates WHERE NOT base_failed),
levels AS (
  SELECT 0 AS level, lang, source, rate, low_end FROM buckets
  UNION ALL SELECT 1, lang, NULL, rate, low_end FROM buckets
  UNION ALL SELECT 2, NULL, NULL, rate, low_end FROM buckets),
sums AS (
  SELECT level, lang, source, rate, low_end, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY low_end) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rate) AS total
  FROM (SELECT level, lang, source, rate, low_end, count(*) AS n FROM levels GROUP BY ALL)),
quart AS (
  SELECT level, lang, source, rate, max(total) AS n, min(low_end) FILTER (WHERE 4 * upto >= total) AS q1,
         min(low_end) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM sums GROUP BY ALL),
fence AS (
  SELECT q.*, q1 - {FENCE} * greatest(q3 - q1, s.least) AS low, q3 + {FENCE} * greatest(q3 - q1, s.least) AS high
  FROM quart q JOIN (VALUES {_RATE_ROWS}) AS s(rate, least) ON q.rate = s.rate),
used AS (
  SELECT o.lang, o.source, o.rate,
         CASE WHEN o.n >= {LEAST_GROUP} THEN o.low WHEN l.n >= {LEAST_GROUP} THEN l.low ELSE a.low END AS low,
         CASE WHEN o.n >= {LEAST_GROUP} THEN o.high WHEN l.n >= {LEAST_GROUP} THEN l.high ELSE a.high END AS high
  FROM fence o JOIN fence l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.rate = o.rate
  JOIN fence a ON a.level = 2 AND a.rate = o.rate WHERE o.level = 0),
broken AS (
  SELECT DISTINCT r.row FROM rates r JOIN used f
    ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source AND f.rate = r.rate
  WHERE {_BEYOND})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND b.row IS NULL AS kept
FROM base d LEFT JOIN broken b ON d.row = b.row
"""
