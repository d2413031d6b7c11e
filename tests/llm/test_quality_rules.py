"""Quality rules: features against a plain count, sketches against sorted values, verdicts against labels."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equipledger.llm import quality_rules as Q

from .conftest import ODD, SF, docs_of


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    c = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if c[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_features_of_whole_texts(documents):
    texts = [r.text for r in documents.collect()] + [r[1] for r in ODD] + ["a b c a b c a b c", "a a a a", "x\n\nx\n \n \nx", "é # é|"]
    texts = [t for t in texts if len(t or "") < 40000] + ["one two three " * 3000]
    for t in texts:
        assert Q.features(t)[:5] == plain(t)


def test_quartiles_of_merged_sketches(spark):
    values = [((i * 7919) % 5000) ** 2 // 997 for i in range(4000)]
    rows = [(("en", "fr")[i % 2], f"s{i % 5}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lang string, source string, v long")
    df = df.select("lang", "source", *[F.col("v").alias(r) for r in Q.RATES])
    got = {(r.level, r.lang, r.source): r for r in Q.quartiles(Q.sketches(df)).where("rate = 'symbol_rate'").collect()}
    for (level, lang, source), r in got.items():
        own = sorted(v for la, so, v in rows if (level > 1 or la == lang) and (level > 0 or so == source))
        assert r.n == len(own)
        for q, part in ((r.q1, 1), (r.q3, 3)):
            exact = own[-(-part * len(own) // 4) - 1]
            assert q <= exact < q + max(1, q // 64 + 1)
    assert len(got) == 10 + 2 + 1


def test_verdicts(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = Q.judged(d).collect()
    assert len(rows) == d.count() and all(not r.kept for r in rows if r.base_failed)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    odd = [r for r in rows if labels.get(r.doc_id) == 0 and r.n_symbols > 100 and not r.base_failed]
    assert odd and not any(r.kept for r in odd)


def test_small_groups_take_their_language(spark):
    text = " ".join(f"word{i}x" for i in range(80))
    marked = text.replace("x", "&&&")
    rows = [(i, text, "en", f"s{i % 20}") for i in range(100)] + [(200, marked, "en", "lonely"), (201, marked, None, None)]
    got = {r.doc_id: r for r in Q.judged(docs_of(spark, rows)).collect()}
    assert not got[200].kept and "symbol_rate" in got[200].broken
    assert not got[201].kept and all(got[i].kept for i in range(100))


def test_odd_rows_and_nothing(odd, nothing):
    got = Q.judged(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r[0], plain(r[1])[0]) for r in ODD)
    assert not any(r.kept for r in got if r.n_words < 50) and all(r.kept is not None for r in got)
    assert Q.judged(nothing).count() == 0


@pytest.mark.parametrize("v", [0, 1, 127, 128, 129, 5000, 10**9])
def test_buckets(spark, v):
    at = spark.range(1).select(Q.bucket(F.lit(v).cast("long"))).first()[0]
    assert at <= v and v - at <= at / 64
