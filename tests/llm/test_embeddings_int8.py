"""Int8 tile products: what the bounds decide, wide vectors, repeated ids, dense groups over many tiles."""

import math

import numpy as np

from equipledger.llm import emb_int8


def brute(rows, threshold=0.95):
    """(n_links, component) per position."""
    x = np.array([v for _, v in rows], float)
    n = np.sqrt((x * x).sum(axis=1))
    near = (x @ x.T) / n[:, None] / n[None, :] >= threshold
    np.fill_diagonal(near, False)
    comp = np.arange(len(rows))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(rows)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    low = {c: min(rows[k][0] for k in np.flatnonzero(comp == c)) for c in set(comp.tolist())}
    return [(i, int(near[k].sum()), low[comp[k]], i == low[comp[k]]) for k, (i, _) in enumerate(rows)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return [tuple(r) for r in emb_int8.near_vectors(df, **how).collect()]


def test_dense_groups_over_many_tiles(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16))
    # cosines spread around the threshold: some pairs are sure, some open, some out
    rows = [(1000 - i, centres[i % 4] + rng.normal(scale=0.2, size=16)) for i in range(400)]
    want = brute(rows)
    for tile in (60, None):
        assert sorted(run(spark, rows, tile=tile)) == sorted(want)


def test_some_pairs_are_sure_and_some_open(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 24)).repeat(50, axis=0) + rng.normal(scale=0.22, size=(200, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    t = emb_int8.Tile(np.arange(200), np.ones(200, np.int64), *emb_int8.quantise(unit))
    got = {(i, j): s for i, j, s in ((int(i), int(j), bool(s)) for b in emb_int8.tile_pairs(t, t, 0.95, True) for i, j, s in zip(*b))}
    cos = unit @ unit.T
    links = {(i, j) for i in range(200) for j in range(i + 1, 200) if cos[i, j] >= 0.95}
    sure = {p for p, s in got.items() if s}
    assert links <= set(got) and sure <= links and sure and set(got) - sure
    # another block length or another order of the rows tells the same pairs
    half = emb_int8.Tile(np.arange(100), np.ones(100, np.int64), t.codes[::2], *(v[::2] for v in (t.scale, t.near, t.error)))
    sub = {(2 * int(i), 2 * int(j)): bool(s) for b in emb_int8.tile_pairs(half, half, 0.95, True) for i, j, s in zip(*b)}
    assert sub == {p: s for p, s in got.items() if p[0] % 2 == 0 and p[1] % 2 == 0}


def test_bounds_hold_for_wide_vectors():
    rng = np.random.default_rng(4)
    for dim in (1, 1024, 1025, 5000):
        x = rng.normal(size=(40, dim)) * rng.choice([1e-3, 1, 50], size=(40, dim))
        x[20:] = x[:20] + rng.normal(scale=0.1, size=(20, dim)) * np.abs(x[:20])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        q, scale, near, error = emb_int8.quantise(unit)
        dots = emb_int8.int_products(q, q)
        assert (dots == q.astype(np.int64) @ q.astype(np.int64).T).all()
        approx = dots.astype(float) * scale[:, None].astype(float) * scale[None, :].astype(float)
        exact = np.array([[math.fsum(a * b) for b in unit] for a in unit])
        bound = near[:, None].astype(float) * error[None, :] + error[:, None] + emb_int8.slack(dim)
        assert (np.abs(approx - exact) <= bound).all()


def test_repeated_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 8))
    rows = [(1, a), (1, b), (2, a), (3, a * 2), (4, b), (5, -b)]
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_wide_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 1500))
    rows = [(i, base[i % 3] + rng.normal(scale=0.23, size=1500)) for i in range(60)]
    assert sorted(run(spark, rows, tile=9)) == sorted(brute(rows))
