"""Memory of the quality model in a task: by what trusted text has seen, not by ALPHABET**4 or the size of a batch."""

import tracemalloc

import numpy as np

from equipledger.llm import kn_quality


def test_model_table_grows_with_seen_contexts(spark):
    docs = spark.createDataFrame([(f"the cat sat on mat {i} and saw the dog {i * i}",) for i in range(50)], "text string")
    score = kn_quality.Model(spark, docs).scorer()
    tracemalloc.start()
    total, n = score("the dog sat on the cat; zebra!")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30 and total < 0
    assert peak < 24 << 20       # a row for every context would take 64 MB


def test_unseen_contexts_have_the_probability_of_the_shorter_one(spark):
    docs = spark.createDataFrame([("abcabdabe " * 5,), ("bca",)], "text string")
    model = kn_quality.Model(spark, docs)
    _, seen, back = model.parts.value
    start, logp = kn_quality.compact(seen, back)
    table = logp[start[:, None] + np.arange(kn_quality.ALPHABET)]
    p = np.full(kn_quality.ALPHABET, 1 / kn_quality.ALPHABET)
    for order in range(1, kn_quality.ORDER + 1):        # the whole table, in double precision
        (g, disc), (h, gamma) = seen[kn_quality.ORDER - order], back[kn_quality.ORDER - order]
        weight = np.ones(kn_quality.ALPHABET ** (order - 1))
        weight[h] = gamma
        p = ((p if order == 1 else np.tile(p, kn_quality.ALPHABET)).reshape(-1, kn_quality.ALPHABET) * weight[:, None]).reshape(-1)
        p[g] += disc
    assert np.allclose(table.reshape(-1), np.log10(np.maximum(p, 1e-12)), atol=1e-4)


def test_grams_are_counted_piece_by_piece():
    parts = [np.array(x, np.int64) for x in ([5, 1, 5], [7], [], [1, 1, 9, 5], [2])]
    for most in (1, 2, 100):
        g, c = kn_quality.added_up(iter(parts), most)
        assert dict(zip(g.tolist(), c.tolist())) == {1: 3, 2: 1, 5: 3, 7: 1, 9: 1}
    assert len(kn_quality.added_up(iter([]))[0]) == 0
    long = lambda: (np.arange(100_000, dtype=np.int64) % 50 for _ in range(60))
    tracemalloc.start()
    assert kn_quality.added_up(long(), 1 << 17)[1].sum() == 6_000_000
    assert tracemalloc.get_traced_memory()[1] < 24 << 20     # all at once: 48 MB and its sorted copy
    tracemalloc.stop()
