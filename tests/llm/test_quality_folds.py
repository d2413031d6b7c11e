"""Quality scores are those of unseen text: folds, thresholds per language, what is rejected."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipledger.llm import kn_quality

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    return docs, labels, kn_quality.fit(docs, labels)


def test_a_document_is_scored_without_its_fold(spark, fitted):
    docs, labels, (models, scored, _) = fitted
    trusted = kn_quality.trusted_documents(docs, labels)
    folded = models[0].parts.value[0]
    text = {r.doc_id: r.text for r in docs.limit(40).collect()}
    got = {r.doc_id: (r.total, r.n) for r in scored.collect()}
    for k in range(kn_quality.FOLDS):
        others = kn_quality._gram_counts(trusted.where(F.col("fold") != k), folded).drop("fold")
        score = kn_quality.Model.of_counts(spark, folded, others).scorer()
        mine = [i for i in text if zlib.crc32(str(i).encode()) % kn_quality.FOLDS == k]
        assert mine
        for i in mine:
            total, n = score(text[i])
            assert got[i] == (pytest.approx(total, rel=1e-6), n)


def test_bounds_are_quantiles_of_the_language(fitted):
    docs, labels, (_, scored, bounds) = fitted
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic != 1}
    rows = [r for r in scored.collect() if r.doc_id in trusted and r.n > 0]
    for b in bounds.collect():
        own = [r for r in rows if b.lang is None or r.lang == b.lang]
        mean = sum(r.total for r in own) / sum(r.n for r in own)
        s = np.sort([(r.total + kn_quality.PRIOR * mean) / (r.n + kn_quality.PRIOR) for r in own])
        low, mid, high = (s[int(np.ceil(q * len(s))) - 1] for q in (kn_quality.LOW, 0.5, kn_quality.HIGH))
        assert b["mean"] == pytest.approx(mean)
        assert (b.low, b.high) == (pytest.approx(mid + kn_quality.REACH * (low - mid)), pytest.approx(mid + kn_quality.REACH * (high - mid)))


def test_low_quality_goes_and_clean_stays(fitted):
    docs, labels, (_, scored, bounds) = fitted
    keep = {r.doc_id: r.keep for r in kn_quality.judged(scored, bounds).collect()}
    rows = labels.collect()
    assert np.mean([keep[r.doc_id] for r in rows if r.quality == 0]) <= 0.1
    assert np.mean([keep[r.doc_id] for r in rows if r.quality == 1 and r.toxic != 1]) >= 0.99


def test_every_trusted_document_trains(spark):
    """No cap: the model learns from all trusted documents, more than the 20,000 it once stopped at."""
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 100 == 0, 1).alias("toxic"))
    assert kn_quality.trusted_documents(docs, labels).count() == 20_500 - 205
    assert kn_quality.trusted_documents(docs, labels, limit=10).count() == 10


def test_trusted_texts_are_not_shuffled(spark, monkeypatch):
    """Whatever the size of the labels, texts stay where they are; ids that share a bit are told apart exactly."""
    monkeypatch.setattr(kn_quality, "BITS", 256)
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "text 7"), (None, "no id"), (-5, "text -5"), (12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(0, 300, 7), 7, -5, 12, 10_000]] + [(None, 1, 0), (14, 0, 0), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    good = {*range(0, 300, 7), -5, 12}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trusted = kn_quality.trusted_documents(docs, labels)
        plan = trusted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        assert sorted(str(r.text) for r in trusted.collect()) == sorted(str(t) for i, t in rows if i in good)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
