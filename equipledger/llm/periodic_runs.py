"""Periodic runs of words by descending-LCP Kruskal.

A text's suffixes are sorted by prefix doubling and neighbours get their longest common prefix (LCP, in words). Classes of
suffixes are united in the order of decreasing LCP by union-find; every class keeps the ordered set of its positions. Two
positions that become neighbours in a set when classes meet at LCP l, at a distance d <= l, repeat with period d
over l + d words: they seed a run. A seed whose left neighbour would keep the period is the same run met later, so only the
leftmost one counts.

Such a d is the smallest period: were q < d one, it would divide d (the stretch has 2 d words or more), the suffix at q would share
more than l words with the first, and the two would not be neighbours. Each run is met, since its first two period
starts share length - d >= d words and no suffix between them shares as many.

Only LCPs from which a run of the wanted kind can come are united: length - period >= max(min_words - q, (exponent - 1) q) >=
min_words (exponent - 1) / exponent for every period q. The bound is exact; no run is lost by it.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from equipledger.llm.common import table

MIN_WORDS = 24
EXPONENT = 3
BATCH_WORDS = 200_000       # words of one numpy pass over several texts; a longer text has a pass of its own
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of ``key`` and their number."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    step = np.empty(len(k), np.int64)
    step[:1] = 0
    step[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(step)
    return out, (int(out[order[-1]]) + 1 if len(k) else 0)


def _doubled(rank: np.ndarray, n: int, width: int) -> tuple[np.ndarray, int]:
    """Ranks of the substrings twice as long as those ``rank`` tells apart; beyond the end is least."""
    ahead = np.zeros(len(rank), np.int64)
    ahead[:len(rank) - width] = rank[width:] + 1 if width < len(rank) else 0
    return _ranks(rank * (n + 2) + ahead)


def suffix_lcp(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the one before it in that array) of whole numbers."""
    rank, n = _ranks(words)
    levels, width = [rank], 1
    while n < len(words):
        rank, n = _doubled(rank, n, width)
        levels.append(rank)
        width *= 2
    sa = np.argsort(rank, kind="stable")
    lcp = np.zeros(len(words), np.int64)
    a, b = sa[1:].copy(), sa[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):      # the last level tells all suffixes apart
        size, r = 1 << k, levels[k]
        fits = np.flatnonzero((a + size <= len(words)) & (b + size <= len(words)))
        fits = fits[r[a[fits]] == r[b[fits]]]
        a[fits] += size
        b[fits] += size
        lcp[fits + 1] += size
    return sa, lcp


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of at least ``max(min_words, exponent * period)`` words, sorted."""
    least = -(-min_words * (exponent - 1) // exponent)
    sa, lcp = suffix_lcp(words)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    w, sa, lcp = words.tolist(), sa.tolist(), lcp.tolist()
    parent = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    found = []
    for e in edges.tolist():
        common = lcp[e]
        for i in (sa[e - 1], sa[e]):
            if i not in parent:
                parent[i], members[i] = i, [i]
        small, large = find(sa[e - 1]), find(sa[e])
        if len(members[small]) > len(members[large]):
            small, large = large, small
        have, new = members[large], members.pop(small)
        parent[small] = large
        seeds = []
        if 8 * len(new) < len(have):
            for x in new:
                at = bisect_left(have, x)
                have.insert(at, x)
            came = set(new)
            for x in new:
                at = bisect_left(have, x)
                if at:
                    seeds.append((have[at - 1], x))
                if at + 1 < len(have) and have[at + 1] not in came:
                    seeds.append((x, have[at + 1]))
        else:
            came = set(new)
            have += new
            have.sort()             # two sorted stretches: merged in one pass
            seeds = [(x, y) for x, y in zip(have, have[1:]) if (x in came) != (y in came)]
        for x, y in seeds:
            d = y - x
            if d <= common and (x == 0 or w[x - 1] != w[y - 1]) and common + d >= max(min_words, exponent * d):
                found.append((x, common + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _may_hold_runs(texts: list[np.ndarray], least: int) -> list[bool]:
    """Whether some stretch of ``least`` words may occur twice in the text, for several texts in one numpy pass: equal
    stretches have equal hashes, so no such text is missed; a chance hit costs a look at that text."""
    sizes = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes.tolist()])    # words from here to the end of the text
    with np.errstate(over="ignore"):
        h = (np.concatenate(texts).astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        width = 1
        while width < least:                 # the last two stretches may overlap
            step = min(width, least - width)
            ahead = np.zeros_like(h)
            ahead[:max(len(h) - step, 0)] = h[step:]
            h = h * _MIX + ahead
            h ^= h >> np.uint64(31)
            width += step
        h += (doc.astype(np.uint64) + np.uint64(1)) * _MIX
    whole = np.flatnonzero(left >= least)
    h = h[whole]
    s = np.sort(h)
    out = np.zeros(len(texts), bool)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        out[doc[whole[np.isin(h, twice)]]] = True
    return out.tolist()


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document with the periodic tail that its id calls for (none for a null id)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that lie in some run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:              # sorted by start, then period: an equal one later does not win
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


FIELDS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = _strongest(runs)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    rest = b" ".join(collapsed(words, runs))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(rest).hexdigest(), runs, rest.decode("utf-8", "surrogatepass"))


def _solved(texts: list[list[bytes]]) -> list[tuple]:
    """A row per text; texts are looked at together, those with a stretch that repeats one by one."""
    code: dict[bytes, int] = {}
    for t in texts:
        for w in set(t).difference(code):
            code[w] = len(code)
    coded = [np.fromiter(map(code.__getitem__, t), np.int64, len(t)) for t in texts]
    least = -(-MIN_WORDS * (EXPONENT - 1) // EXPONENT)
    able = [i for i, c in enumerate(coded) if len(c) >= MIN_WORDS]
    runs: list[list] = [[] for _ in texts]
    if able:
        for i, may in zip(able, _may_hold_runs([coded[i] for i in able], least)):
            if may:
                runs[i] = runs_of(coded[i])
    return [_row(t, r) for t, r in zip(texts, runs)]


def with_runs(docs: DataFrame, damage=None, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, the strongest run, digests and, with ``texts``, ``runs`` (array of start, length,
    period) and ``collapsed`` (the kept words joined by one space).

    Null, empty and blank texts have no words and no runs (four nulls, digests of nothing). Ties of the strongest run go to the
    smallest start, then period. Repeated rows and rows without an id are rows like any other; an empty table gives no
    rows; extra columns are ignored. ``damage(words, doc_id)`` may change the words first."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, {FIELDS}"
    if texts:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        if texts:
            names, types = [*names, "runs", "collapsed"], [*types, pa.list_(span), pa.string()]

        def out(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            if texts:
                rows = [(*r[:7], [dict(zip(("start", "length", "period"), x)) for x in r[7]], r[8]) for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", *names])

        for b in batches:
            id_type = b.schema.field(0).type
            ids, held, size = [], [], 0
            for doc_id, text in zip(b.column(0), b.column(1)):
                doc_id = doc_id.as_py()
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = damage(words, doc_id) if damage else words
                if held and size + len(words) > BATCH_WORDS:
                    yield out(ids, _solved(held))
                    ids, held, size = [], [], 0
                ids.append(doc_id)
                held.append(words)
                size += len(words)
            if held:
                yield out(ids, _solved(held))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_runs(table(spark, sf_dir, "documents"), damage=planted, texts=False)
