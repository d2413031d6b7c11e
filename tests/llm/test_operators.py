"""The training-data operators against brute force, on sf0.001 and on rows with nulls, empty and very long texts,
ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equipledger.llm import components, crf_lang, emb_int8, gru_lm, kd_shards, kn_quality, pfair, pii, simhash, sp_lattice, syncmers

from .conftest import ODD, SF, docs_of


def collected(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def bytes_of(t):
    return len((t or "").encode())


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_kd_shards(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    got = kd_shards.kd_shards(docs, shards=24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, bytes_of(r.text) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(24))
    if which == "documents":
        total, largest = sum(r.size for r in got), max(r.size for r in got)
        assert all(abs(sum(r.size for r in v) - total / 24) <= 2 * largest for v in by.values())


def test_kd_shards_cuts_a_group_of_copies(spark):
    docs = docs_of(spark, [(i, "same text for all of them", "en", "a") for i in range(3000)])
    sizes = Counter(r.shard for r in kd_shards.kd_shards(docs, shards=24).collect())
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 3


def test_kd_shards_target_and_empty(documents, nothing):
    total = sum(bytes_of(r.text) + 8 for r in documents.collect())
    assert kd_shards.kd_shards(documents, target_bytes=total // 5 + 1).agg(F.countDistinct("shard")).first()[0] == 5
    assert kd_shards.kd_shards(nothing, shards=24).count() == 0


# ---------------------------------------------------------------- SimHash
def brute_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in nodes:
        for b in nodes:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_on_documents(documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    fp = {k: brute_fp(t) for k, t in text.items()}
    want = brute_components(sorted(fp), lambda a, b: a < b and (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(documents).collect()}
    assert got == {k: (fp[k], want[k]) for k in fp}


def test_simhash_crowds_and_chains(spark, monkeypatch):
    """Chains that drift apart, crowds in one segment and chunk pairs: components as by all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(5)
    fps = {0, 1, 2**64 - 1}
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(60):
            for b in rng.choice(64, size=int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {(0xABCD1234 << 32) | int(v) for v in rng.integers(0, 2**32, 200)}
    fps = sorted(fps)
    ids = [int(i) for i in rng.permutation(len(fps))]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    reps = spark.createDataFrame(list(zip(ids, signed)), "id long, fp long")
    of = dict(zip(ids, fps))
    want = brute_components(sorted(ids), lambda a, b: a < b and (of[a] ^ of[b]).bit_count() <= 3)
    got = {i: i for i in ids} | {r.id: r.component_id for r in components.connected_components(simhash.near_edges(reps)).collect()}
    assert got == want


def test_simhash_odd_rows(odd, nothing):
    got = collected(simhash.near_groups(odd), "doc_id", "fp", "component_id")
    assert Counter(g[:2] for g in got) == Counter(
        (r[0], (f := brute_fp(r[1])) - 2**64 * (f >= 2**63)) for r in ODD)
    comp = {g[0]: g[2] for g in got if g[0] is not None}
    assert comp[2] == comp[3] == 1 and comp[6] == 5 and comp[12] == 11 and comp[7] == 7
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter({1: 1, 4: 1, 5: 1, 7: 1, 9: 1, 10: 1, 11: 1})
    assert simhash.near_groups(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    got = components.connected_components(spark.range(400).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(got) == 401 and {r.component_id for r in got} == {0}


# ---------------------------------------------------------------- PII
def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn,
                    "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


TRICKY = ["a@b.c_d@e.f", "x a.b@c..d a@b@c.de", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111-", "4111-1111-1111-1112",
          "+1 (988) 555-2485. +49 30 1234567890123456", "1 2 3@x.yz 5.5.5.5@q.r", "a@b a@b.c. a%+-@-.-", "+1+12345678901 12345678901234567890123",
          "٣.٤.٥.٦ 1.2.3.٤", "é@é.com u@é.com ü.a@b.co"]


def test_pii_base_spans(spark, documents):
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.with_spans(docs).collect():
        assert [tuple(s)[:3] for s in r.spans if s.kind in pii.KINDS[:4]] == brute_spans(text[r.doc_id]), text[r.doc_id][:80]


def test_pii_random_strings():
    rng = np.random.default_rng(2)
    for _ in range(4000):
        t = "".join(rng.choice(list("a.@-+ 019%(é"), size=int(rng.integers(1, 40))))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.KINDS[:4]] == brute_spans(t), t


def test_pii_checksums_context_and_mask(spark, odd, nothing):
    assert [s[0] for s in pii.find_spans("pay to IBAN DE89 3704 0044 0532 0130 00 now")] == ["iban"] or "iban" in {
        s[0] for s in pii.find_spans("pay to IBAN DE89 3704 0044 0532 0130 00 now")}
    assert not [s for s in pii.find_spans("IBAN DE88370400440532013000") if s[0] == "iban"]
    assert [s[0] for s in pii.find_spans("my social security number 123-45-6789")] == ["ssn"]
    assert not pii.find_spans("part 123-45-6789") and not pii.find_spans("666-45-6789 ssn")
    assert pii.score("call 1", "phone", 5, 6) > pii.score("xxxx 1", "phone", 5, 6)
    assert pii.masked("mail a@b.cd, +1 (988) 555-2485!") == "mail <EMAIL>, <PHONE>!"
    assert pii.masked(None) is None and pii.masked("") == ""
    out = pii.mask_pii(odd)
    assert out.columns == odd.columns
    assert Counter(collected(out, "doc_id", "text")) == Counter((r[0], pii.masked(r[1])) for r in ODD)
    assert pii.mask_pii(nothing).count() == 0 and pii.with_spans(nothing).count() == 0


# ---------------------------------------------------------------- syncmers
def brute_anchors(t, s64):
    words = [s64(w) for w in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", t or "")]
    return words


def test_syncmers(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    got = {r.doc_id: r for r in syncmers.fingerprints(documents).collect()}
    sets = defaultdict(set)
    for r in syncmers.anchors(documents).collect():
        sets[r.doc_id].add(r.anchor)
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        nxt_id, nxt = rows[(i + 1) % len(rows)]
        e = len(t) // 4
        edited = t[:len(t) - e] + nxt[:e]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(sets[k])[:syncmers.KEPT])
        a, b = sorted(sets[k])[:syncmers.KEPT], sorted(sets[nxt_id])[:syncmers.KEPT]
        u = sorted(set(a) | set(b))[:syncmers.KEPT]
        assert r.near_next == pytest.approx(len(set(u) & set(a) & set(b)) / len(u) if u else 1.0)
    assert np.mean([r.near_edited for r in got.values()]) > 0.45
    again = {}
    for k, t in rows:
        assert again.setdefault(t, got[k].fingerprint) == got[k].fingerprint


def test_syncmers_are_closed_and_context_free(spark):
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 50, 300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x y z q " + " ".join(words) + " p o")], "doc_id long, text string")
    a = [r.anchor for r in syncmers.anchors(docs).where("doc_id = 1").orderBy("position").collect()]
    b = [r.anchor for r in syncmers.anchors(docs).where("doc_id = 2").orderBy("position").collect()]
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(words)], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    pairs = [(h[x], h[y]) for x, y in zip(words, words[1:])]
    s = [r.s for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").orderBy("i").selectExpr("xxhash64(a, b) s").collect()]
    closed = [(s[i], s[i + 2]) for i in range(len(s) - 2) if min(s[i:i + 3]) in (s[i], s[i + 2])]
    want = [r.v for r in spark.createDataFrame([(i, *p) for i, p in enumerate(closed)], "i int, a long, b long").orderBy("i")
            .selectExpr("xxhash64(a, b) & 4294967295 v").collect()]
    assert a == want
    assert " ".join(map(str, a)) in " ".join(map(str, b))     # the passage keeps its anchors, whatever stands around it


def test_syncmers_odd_rows(spark, odd, nothing):
    got = syncmers.fingerprints(odd).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], len(r[1] or "")) for r in ODD)
    one = docs_of(spark, [(5, "abcdefgh", "en", "a")])
    assert collected(syncmers.fingerprints(one), "edited_sha256") == [(hashlib.sha256(b"abcdefab").hexdigest(),)]
    assert syncmers.fingerprints(nothing).count() == 0
    assert syncmers.fingerprints(docs_of(spark, [(None, "a b c d e", "en", "a"), (None, None, None, None)])).count() == 2
    far = docs_of(spark, [(i if i < 50 else 10**15 + i, f"text number {i} of some", "en", "a") for i in range(60)])
    ordered = sorted(far.collect(), key=lambda r: r.doc_id)
    shas = {r.doc_id: r.edited_sha256 for r in syncmers.fingerprints(far).collect()}
    for r, n in zip(ordered, ordered[1:] + ordered[:1]):
        e = len(r.text) // 4
        assert shas[r.doc_id] == hashlib.sha256((r.text[:len(r.text) - e] + n.text[:e]).encode()).hexdigest()


# ---------------------------------------------------------------- quality
def brute_kn(texts, folded):
    """Interpolated modified Kneser-Ney, straight from its definition, on dictionaries."""
    order = kn_quality.ORDER
    counts = Counter()
    for t in texts:
        s = [0] * (order - 1) + [int(folded[ord(c)]) for c in t]
        counts.update(tuple(s[i:i + order]) for i in range(len(t)))
    levels = [counts]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    spec = []
    for c in levels:
        n = Counter(c.values())
        n1, n2, n3, n4 = n[1], n[2], n[3], n[4]
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = (max(0.05, 1 - 2 * y * n2 / n1) if n1 else 0.5, min(1.9, max(0.1, 2 - 3 * y * n3 / n2)) if n2 else 1.0,
             min(2.9, max(0.15, 3 - 4 * y * n4 / n3)) if n3 else 1.5)
        cut = lambda k, d=d: d[min(k, 3) - 1]
        total, kept = Counter(), defaultdict(float)
        for g, k in c.items():
            total[g[:-1]] += k
            kept[g[:-1]] += cut(k)
        spec.append((c, cut, total, kept))

    def p(g):
        if not g:
            return 1 / kn_quality.ALPHABET
        c, cut, total, kept = spec[order - len(g)]
        h = g[:-1]
        lower = p(g[1:])
        if not total[h]:
            return lower
        return (c[g] - cut(c[g]) if c[g] else 0) / total[h] + kept[h] / total[h] * lower
    return p


def test_kneser_ney_is_the_definition(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = [r.text for r in kn_quality.trusted_documents(documents, labels).collect()]
    model = kn_quality.Model(spark, spark.createDataFrame([(t,) for t in texts], "text string"))
    folded = model.parts.value[0]
    p = brute_kn(texts, folded)
    score = model.scorer()
    rng = np.random.default_rng(4)
    for t in [texts[0][:200], "Zzq%% 的 the the", *(("".join(rng.choice(list("the ofaß%Q"), 30))) for _ in range(5))]:
        s = [0, 0, 0] + [int(folded[min(ord(c), len(folded) - 1)]) for c in t]
        want = sum(math.log10(p(tuple(s[i:i + 4]))) for i in range(len(t)))
        assert score(t)[0] == pytest.approx(want, rel=1e-3)
    context = sum(10 ** float(score("the" + chr(c))[0] - score("the")[0]) for c in np.flatnonzero(folded > 1))
    assert 0.8 < context <= 1.0001


def test_quality_keeps_trusted_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.keep for r in kn_quality.quality(docs, labels).collect()}
    lab = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [got[k] for k, v in lab.items() if v == 1], [got[k] for k, v in lab.items() if v == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.5
    kept = kn_quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(k for k, v in got.items() if v)


def test_quality_odd_rows(spark, odd, nothing, documents):
    labels = spark.createDataFrame([(11, 1, 0), (11, 1, 0), (4, 1, None), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = kn_quality.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.keep for r in got if not r.n_chars)
    assert kn_quality.keep_quality(odd, labels).columns == odd.columns
    none = spark.createDataFrame([], labels.schema)
    assert all(r.keep for r in kn_quality.quality(odd, none).collect())
    assert kn_quality.quality(nothing, none).count() == 0 and kn_quality.keep_quality(nothing, labels).count() == 0


# ---------------------------------------------------------------- pieces
def test_lattice_is_the_brute_force_best_path(spark):
    pieces = sp_lattice.load_pieces()
    words = [" the", "ing", " 的x", "ñ▁", "...!!", "  hello", " internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\n", "é́", "👩‍🚀", "x" * 60]
    got = {r.word: tuple(r.ids) for r in sp_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert got == {w: sp_lattice.encode_word(w, pieces) for w in words}
    more = [*words, "", "y" * 200, "a\x00", *{"".join(x) for x in np.random.default_rng(1).choice(list(" theraoinñ.的\n1"), (3000, 9))}]
    assert sp_lattice.ArrayLattice(pieces).encode(more) == [np.array(sp_lattice.encode_word(w, pieces), dtype="<i4").tobytes() for w in more]

    def paths(w):
        if not w:
            yield 0.0
        for n in range(1, min(len(w), pieces.longest) + 1):
            s = pieces.score.get(w[:n], sp_lattice.BYTE_SCORE * len(w[:1].encode()) if n == 1 else None)
            if s is not None:
                for r in paths(w[n:]):
                    yield s + r
    value = {i: pieces.score[p] for p, i in pieces.number.items()}
    for w in words[:7]:
        ids = got[w]
        own = sum(value.get(i, sp_lattice.BYTE_SCORE) for i in ids)
        assert own == pytest.approx(max(paths(w)))


def test_pieces_round_trip(spark, documents, odd, nothing):
    for docs in (documents, odd):
        d = sp_lattice.decode(sp_lattice.encode(docs, head_words=500))
        assert all(r.round_trip and r.decoded == (r.text or "") and r.n_pieces == len(r.ids) for r in d.collect())
    pieces = sp_lattice.load_pieces()
    cut = re.compile(pieces.pattern)
    want = {r.doc_id: [i for w in sp_lattice.words_of(r.text, cut) for i in sp_lattice.encode_word(w, pieces)] for r in documents.collect()}
    assert {r.doc_id: r.ids for r in sp_lattice.encode(documents).collect()} == want
    assert sp_lattice.decode(sp_lattice.encode(nothing)).count() == 0


# ---------------------------------------------------------------- language
def test_crf_marginals_are_brute_force():
    m = crf_lang.Crf(["a", "b", "c"], {})
    rng = np.random.default_rng(0)
    m.trans, m.begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 4, 2, 1])
    e = rng.normal(size=(4, 4, 3))
    prob, _ = m.marginals(e.copy(), lengths)
    import itertools
    for k, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            s = m.begin[path[0]] + sum(e[i, k, path[i]] for i in range(n)) + sum(m.trans[path[i], path[i + 1]] for i in range(n - 1))
            for i in range(n):
                want[i, path[i]] += math.exp(s)
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(prob[:n, k], want, atol=1e-6)


def test_crf_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = docs.where(crf_lang.doc_bucket(5) != 0)
    m = crf_lang.fit(labelled)
    got = {r.doc_id: r for r in crf_lang.identify(docs, m).collect()}
    held = [r for r in docs.where(crf_lang.doc_bucket(5) == 0).collect() if r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    by = {}
    for r in held:
        if len(crf_lang.words_of(r.text)) > 60:
            by.setdefault(r.lang, r.text)
    a, b = sorted(by)[:2]
    cut = lambda x: " ".join(x.split()[:40])
    mixed = cut(by[a]) + " " + cut(by[b])
    runs = crf_lang.label([mixed], m)[0][2]
    assert {a, b} <= {r[0] for r in runs} and len(runs) <= 8
    assert all(0 <= r.score <= 1 for r in got.values())


def test_crf_odd_rows(spark, odd, nothing):
    m = crf_lang.fit(odd)
    got = crf_lang.identify(odd, m).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 10) or (r.doc_id is None and r.n_words == 0)) for r in got)
    assert crf_lang.fit(nothing) is None and crf_lang.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in crf_lang.identify(odd, None).collect()} == {"und"}


# ---------------------------------------------------------------- recurrent model
def test_lm_counts_and_base_score(spark, documents):
    d = {r.doc_id: r for r in gru_lm.op6_gru_lm(spark, SF).collect()}
    text = {r.doc_id: r.text for r in documents.collect()}
    toks = {k: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for k, t in text.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in text}
    c = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in toks.items():
        r = d[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r.score) and r.score < 0


def test_lm_tail_words_meet_their_counts(spark, documents, monkeypatch):
    """With a tiny head nearly all counts come from the join; nothing may change but rounding."""
    train = documents.where(gru_lm.doc_bucket(7) != 2)
    a = {r.doc_id: r for r in gru_lm.log_likelihood(documents, train).collect()}
    monkeypatch.setattr(gru_lm, "HEAD_WORDS", 2000)
    b = {r.doc_id: r for r in gru_lm.log_likelihood(documents, train).collect()}
    for k in a:
        assert a[k].n_known == b[k].n_known and a[k].base_score == pytest.approx(b[k].base_score)
        assert a[k].score == pytest.approx(b[k].score, rel=1e-4)


def test_lm_gradient_is_the_numeric_one():
    rng = np.random.default_rng(0)
    g = gru_lm.Gru(rng.integers(1, 50, gru_lm.SHORT).astype(float), rng.integers(1, 50, gru_lm.TAILS).astype(float))
    for n in g.NAMES:
        setattr(g, n, getattr(g, n).astype(np.float64))
    ids = rng.integers(0, gru_lm.SHORT + gru_lm.TAILS, (6, 3))
    ids[4:, 2] = -1
    end, last = 5, np.full(3, 5)

    def loss():
        h, prev, total, n = np.zeros((3, gru_lm.HIDDEN)), last, 0.0, 0
        for t in ids:
            h = np.where((prev == end)[:, None], 0.0, h)
            new = g.step(g.x[prev], h)[0]
            ok = t >= 0
            cls = np.where(t < gru_lm.SHORT, t // gru_lm.WORDS_IN_CLASS, gru_lm.CLASSES + t - gru_lm.SHORT)
            total -= g.log_prob(new[ok], cls[ok], t[ok] % gru_lm.WORDS_IN_CLASS).sum() * math.log(10)
            n += ok.sum()
            h, prev = np.where(ok[:, None], new, h), np.where(ok, t, prev)
        return total / n
    _, _, grad = g._window(ids, np.zeros((3, gru_lm.HIDDEN)), last, end)
    for name in g.NAMES:
        a = getattr(g, name).reshape(-1)
        for k in np.argsort(-np.abs(grad[name].reshape(-1)))[:4]:
            old = a[k]
            a[k] = old + 1e-4
            up = loss()
            a[k] = old - 1e-4
            down = loss()
            a[k] = old
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-5), name


def test_lm_beats_the_unigram_base_on_held_out_text(spark):
    d = gru_lm.op6_gru_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert d[0] > d[1]


def test_lm_odd_rows(spark, odd, nothing):
    got = gru_lm.log_likelihood(odd, odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len((r[1] or "").split()) + 1) for r in ODD)
    assert gru_lm.log_likelihood(nothing, nothing).count() == 0
    alone = gru_lm.log_likelihood(odd, nothing).collect()
    assert len(alone) == len(ODD) and all(r.n_known == 0 and math.isfinite(r.score) for r in alone)


# ---------------------------------------------------------------- embeddings
def brute_vectors(rows, threshold=0.95):
    ok = {k: np.array(v, dtype=float) for k, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {k: [] for k, _ in rows}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and len(x) == len(y) and float(x @ y) / math.sqrt(float(x @ x)) / math.sqrt(float(y @ y)) >= threshold:
                links[a].append(b)
    comp = brute_components(sorted(links), lambda a, b: b in links[a])
    return {k: (len(v), comp[k], comp[k] == k) for k, v in links.items()}


def test_embeddings(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb_int8.near_vectors(vecs, tile=64).collect()}
    assert got == brute_vectors([(r.vec_id, r.embedding) for r in vecs.collect()])


def test_embeddings_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in base[i % 5] + rng.normal(scale=0.12, size=8)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0, None] + [0.0] * 6), (103, [float("nan")] * 8), (104, [float("inf")] + [1.0] * 7), (105, []),
             (106, rows[0][1]), (107, rows[0][1]), (108, [x * 1e200 for x in rows[1][1]]), (109, [x * 1e-200 for x in rows[1][1]]), (110, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"tile": F.lit(1), "node": F.lit(2), "slot": F.lit(0)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb_int8.near_vectors(df, tile=16).collect()}
    scaled = [(k, None if v is None else [x / max(map(abs, v)) for x in v] if k in (108, 109) else v) for k, v in rows]
    assert got == brute_vectors(scaled)
    assert emb_int8.near_vectors(df.limit(0)).count() == 0


def test_embedding_bound_is_rigorous():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, near, err = emb_int8.quantise(x)
    approx = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(approx - x @ x.T) <= near[:, None] * err[None, :] + err[:, None] + 1e-12).all()


# ---------------------------------------------------------------- mixing
def brute_cycle(m):
    q, had, out = sum(m.values()), dict.fromkeys(m, 0), []
    for t in range(q):
        free = [(-(-(had[s] + 1) * q // m[s]), s) for s in m if had[s] < m[s] and had[s] * q // m[s] <= t]
        out.append(min(free)[1])
        had[out[-1]] += 1
    return out


@pytest.mark.parametrize("m", [{"sa": 1, "sb": 1}, {"sa": 7, "sb": 2, "sc": 1}, {"sa": 333, "sb": 333, "sc": 334}, {f"s{i:02d}": 1 + i * i for i in range(12)}])
def test_pfair_cycle(spark, m):
    got = pfair.cycle_order(spark.createDataFrame(list(m.items()), "src string, m int")).collect()
    order = {t: r.src for r in got for t in r["at"]}
    q = sum(m.values())
    assert [order[t] for t in range(q)] == brute_cycle(m)
    had = Counter()
    for t in range(q):
        had[order[t]] += 1
        assert all(abs(had[s] - m[s] * (t + 1) / q) < 1 for s in m)


def test_pfair_mix_keeps_shares_and_rows(spark, documents):
    d = pfair.pfair_mix(documents, block_bytes=4096).collect()
    assert Counter(r.doc_id for r in d) == Counter(r.doc_id for r in documents.collect())
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in d)
    blocks = {(r.mix_slot): r.source for r in d}
    assert all(len({r.source for r in d if r.mix_slot == s}) == 1 for s in blocks)
    by = defaultdict(list)
    for r in d:
        by[r.source].append(r)
    for v in by.values():
        v.sort(key=lambda r: r.mix_offset)
        at = 0
        for r in v:
            assert r.mix_offset == at and r.mix_block == at // 4096
            at += r.mix_bytes
    out = pfair.mixed(documents, block_bytes=4096)
    assert out.columns == documents.columns
    place = {r.doc_id: (r.mix_slot, r.mix_offset) for r in d}
    order = [place[r.doc_id] for r in out.collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 1 / 3, **{f"s{i:02d}": 2 / 57 for i in range(19)}},
                                     {"a": 0.9995, "b": 0.0005}])
def test_pfair_shares_stay_within_a_block_of_the_weights(spark, weights):
    """Over thousands of slots, not only over one round of rounded shares."""
    from fractions import Fraction
    total, slots = sum(map(Fraction, weights.values())), 3000
    w = {f"s{s}": Fraction(x) / total for s, x in weights.items()}
    sharing = pfair.shares(spark.createDataFrame([(s, 1) for s in w], "src string, bytes long"), weights, 1.0)
    got = pfair.order_of(sharing.withColumn("blocks", F.lit(slots))).where(F.col("slot") < slots).collect()
    order = {r.slot: r.src for r in got}
    assert sorted(order) == list(range(slots)) and len(got) == slots
    assert all(r.release <= r.slot < r.deadline for r in got)
    had = Counter()
    for t in range(slots):
        had[order[t]] += 1
        assert all(abs(had[s] - w[s] * (t + 1)) < 1 + 1e-6 for s in w), t


def test_pfair_odd_rows(spark, odd, nothing):
    d = pfair.pfair_mix(odd, weights={"a": 3, None: 1})
    assert d.count() == len(ODD) and set(odd.columns) <= set(d.columns)
    assert {r.source for r in d.where("mix_slot is null").collect()} == {"b"}
    assert pfair.mixed(odd).count() == len(ODD) and pfair.mixed(odd).columns == odd.columns
    assert pfair.mixed(nothing).count() == 0 and pfair.pfair_mix(odd, weights={}).where("mix_slot is not null").count() == 0
