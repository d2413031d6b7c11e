from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from equipledger.llm import gru_lm


def weights(spark, docs):
    v = gru_lm.vocabulary(gru_lm.count_words(docs))
    return gru_lm.Gru(v.short_counts, v.tails).get(), gru_lm.train(docs, v, spark.sparkContext.broadcast(vars(v))).get()


def test_every_training_document_reaches_the_weights(spark):
    """A table none of whose ids is 0 modulo 32 by hash: the weights leave their start, whichever document is there."""
    some = spark.range(40).where(F.pmod(F.xxhash64("id"), F.lit(32)) != 0).limit(2)
    docs = some.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("one two three four"), 30), "id").alias("text")).cache()
    for part in (docs, docs.limit(1)):
        before, after = weights(spark, part)
        assert not np.allclose(before, after) and np.isfinite(after).all()


def test_scores_are_those_of_a_plain_forward_pass(spark, documents):
    """Token by token with the classes' full distributions, and words outside the short list by their counts."""
    docs = documents.select("doc_id", "text")
    train_on = docs.where("doc_id % 3 <> 0")
    v = gru_lm.vocabulary(gru_lm.count_words(train_on))
    g = gru_lm.train(train_on, v, spark.sparkContext.broadcast(vars(v)))
    n = Counter(w for r in train_on.collect() for w in [*(r.text or "").encode().lower().split(), b" "])
    got = {r.doc_id: r.score for r in gru_lm.log_likelihood(docs, train_on).collect()}
    for r in docs.collect()[:40]:
        words = [*(r.text or "").encode().lower().split(), b" "]
        if len(words) > 400:
            continue
        h, last, total = np.zeros((1, gru_lm.HIDDEN)), v.row[v.rank[b" "]], 0.0
        for w in words:
            h = g.step(g.x[[last]], h)[0]
            rank = v.rank.get(w)
            last = v.row[rank] if rank is not None else gru_lm.SHORT + gru_lm.tail_class(w)
            logit = (h @ g.wc + g.bc)[0].astype(float)
            logp = logit - np.log(np.exp(logit - logit.max()).sum()) - logit.max()
            if last < gru_lm.SHORT:
                c, place = divmod(int(last), gru_lm.WORDS_IN_CLASS)
                own = (h @ g.wo[c] + g.bo[c])[0].astype(float)
                total += (logp[c] + own[place] - np.log(np.exp(own - own.max()).sum()) - own.max()) / np.log(10)
            else:
                k = last - gru_lm.SHORT
                total += logp[gru_lm.CLASSES + k] / np.log(10) + np.log10((n[w] + 1) / v.space[k])
        assert np.isclose(got[r.doc_id], total, rtol=1e-4)


def test_scores_do_not_depend_on_files_and_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 20_000)
    docs = documents.select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in gru_lm.log_likelihood(d, d.where("doc_id % 7 <> 2")).collect()}
                 for d in (docs.coalesce(1), docs.repartition(13)))
    assert all(np.isclose(one[k], many[k], rtol=1e-3) for k in one)
