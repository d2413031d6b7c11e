"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from equipledger.llm import periodic_runs as P

from .conftest import ODD, docs_of


def brute(w, least=24, times=3):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, times * q) and not any(w[s:s + size - r] == w[s + r:s + size] for r in range(1, q)):
                out.add((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2)])
def test_runs_of_random_words(least, times):
    rng, found = random.Random(least), 0
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3)):
            s, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 4))
            for i in range(s + p, rng.randint(s, len(w))):
                w[i] = w[i - p]
        got = P.runs_of(np.array(w, dtype=np.int64), least, times)
        assert got == brute(w, least, times)
        found += len(got)
        if (least, times) == (24, 3):
            assert P._may_hold_runs([np.array(w, dtype=np.int64), np.arange(30)], 16) in ([True, False], [False, False])
            assert not got or P._may_hold_runs([np.arange(30), np.array(w, dtype=np.int64)], 16)[1]
    assert found


def test_query_rows(spark, documents):
    got = {r.doc_id: tuple(r) for r in P.with_runs(documents, damage=P.planted, texts=False).collect()}
    want = {r.doc_id: expected(r.doc_id, r.text) for r in documents.collect() if len((r.text or "").split()) < 3000}
    assert any(w[1] for w in want.values()) and any(not w[1] for w in want.values())
    assert all(got[k] == w for k, w in want.items())
    assert len(got) == documents.count()


def test_odd_rows(spark, odd, nothing):
    got = P.with_runs(odd).collect()
    assert len(got) == len(ODD)
    long = [r for r in got if r.doc_id in (5, 6)]
    assert all((r.n_runs, r.start, r.length, r.period) == (1, 0, 30000, 5) and r.collapsed == "lorem ipsum dolor sit amet" for r in long)
    blank = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all(r.n_runs == 0 and r.start is None and r.exponent_milli is None and r.collapsed == "" for r in blank)
    assert P.with_runs(nothing).count() == 0


def test_ties_and_nested_runs(spark):
    one = "a b c " * 10
    rows = [(1, one + "x " + one, "en", "s"), (2, "a a b " * 12, "en", "s"), (3, ("a " * 30 + "b ") * 4, "en", "s")]
    got = {r.doc_id: r for r in P.with_runs(docs_of(spark, rows)).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (2, 0, 30, 3)
    assert [tuple(x) for x in got[2].runs] == [(0, 36, 3)]
    assert [tuple(x) for x in got[3].runs] == brute(rows[2][1].split()) and got[3].n_runs == 5
