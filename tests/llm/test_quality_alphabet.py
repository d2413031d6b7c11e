"""Every character of trusted text is a symbol of its own: no script is folded away, whatever its share of the corpus."""

import math
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipledger.llm import kn_quality
from tests.llm.test_operators import brute_kn

WORDS = {"en": "the quick brown fox jumps over a lazy dog while five WIZARDS box JET QUAY MKV 0123456789 (and) more",
         "ru": "съешь же ещё этих мягких французских булок да выпей чаю", "zh": "天地玄黄 宇宙洪荒 日月盈昃 辰宿列张 寒来暑往 秋收冬藏"}


def texts(lang, n, seed=0):
    words, rng = WORDS[lang].split(), np.random.default_rng(seed)
    return [" ".join(rng.choice(words, 12)) for _ in range(n)]


def frames(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, n in (("en", 120), ("ru", 40), ("zh", 30)) for t in texts(x, n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


def test_no_character_of_trusted_text_is_folded(spark):
    docs, _ = frames(spark)
    seen = {ord(c) for r in docs.collect() for c in r.text}
    folded = kn_quality._alphabet(docs)
    assert len(seen) > 100 and len({int(folded[c]) for c in seen}) == len(seen) and (folded > 1).sum() == len(seen)
    assert (kn_quality._alphabet(docs, 64) > 1).sum() == 62


def test_scores_are_the_definition_over_all_characters(spark, monkeypatch):
    docs, labels = frames(spark)
    models = kn_quality.cross_fitted(kn_quality.trusted_documents(docs, labels))
    folds = {r.doc_id: (r.fold, r.text) for r in docs.withColumn("fold", kn_quality.fold_of()).collect()}
    for k, model in enumerate(models):
        folded = model.parts.value[0]
        size = kn_quality.size_of(folded)
        assert size > 100
        p = brute_kn([t for fold, t in folds.values() if fold != k], folded)
        for t in [*(texts(x, 1, 9)[0] for x in WORDS), "玄宇 булка 的 % Ω", "чя the天"]:
            s = [0, 0, 0] + [int(folded[ord(c)]) for c in t]
            with monkeypatch.context() as m:
                m.setattr(kn_quality, "ALPHABET", size)     # the uniform share of the definition
                want = sum(math.log10(p(tuple(s[i:i + 4]))) for i in range(len(t)))
            assert model.scorer()(t)[0] == pytest.approx(want, rel=1e-4)


def test_a_rarer_script_is_told_from_its_letters_shuffled(spark):
    docs, labels = frames(spark)
    score = kn_quality.cross_fitted(kn_quality.trusted_documents(docs, labels))[0].scorer()
    rng = np.random.default_rng(1)
    for lang in WORDS:
        for t in texts(lang, 5, 7):
            assert score(t)[0] - score("".join(rng.permutation(list(t))))[0] > 0.3 * len(t)


def test_long_texts_with_rare_symbols_are_scored_over_window_ends(spark):
    docs, labels = frames(spark)
    score = kn_quality.cross_fitted(kn_quality.trusted_documents(docs, labels))[0].scorer()
    t = " ".join(texts("zh", 40, 3) + texts("en", 40, 3))
    many = (1 << 19) // len(t) + 1
    once, twice, whole = score(t)[0], score(t + t)[0], score(t * many)[0]
    assert whole == pytest.approx(once + (many - 1) * (twice - once), rel=1e-6)


def test_more_symbols_than_a_number_holds(spark):
    """55,109 symbols or more: a 4-gram's number passes 63 bits."""
    every = "".join(chr(c) for c in range(0x20, 0x20 + 57_000) if not 0xD800 <= c <= 0xDFFF)
    rows = [every, every[::2], "".join(reversed(every)), "abcabdabe " * 3]
    model = kn_quality.Model(spark, spark.createDataFrame([(t,) for t in rows], "text string"), most=None)
    folded, seen, back = model.parts.value
    size = kn_quality.size_of(folded)
    assert size ** 4 >= 1 << 63 and np.iscomplexobj(seen[0][0])
    h, w = kn_quality.parted(seen[0][0], size)
    assert (kn_quality.numbers(h, w, 4, size) == seen[0][0]).all()
    score = model.scorer()
    at = every[40_000:40_040]
    assert score(at)[0] > score("".join(np.random.default_rng(2).permutation(list(at))))[0] + 20
    assert len(seen[0][0]) == len({x[max(0, i - 3):i + 1] if i >= 3 else (i, x[:i + 1]) for x in rows for i in range(len(x))})


def test_the_pipeline_drops_odd_text_in_a_rarer_script(spark):
    rng = np.random.default_rng(5)
    signs = string.ascii_letters + string.digits        # every one of them more frequent than those of the rarer script
    latin = [" ".join(signs[k:k + 4] for k in rng.integers(0, 59, 12)) for _ in range(800)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate([*(("en", t) for t in latin), *(("zh", t) for t in texts("zh", 80, 4))])]
    mixed = lambda t: " ".join("".join(rng.choice(list(t.replace(" ", "")), len(w))) for w in t.split())
    odd = [(1000 + i, mixed(t), "zh") for i, t in enumerate(texts("zh", 20, 6))]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kn_quality.keep_quality(docs, labels).collect()}
    assert not kept & {r[0] for r in odd} and len(kept) >= 0.95 * len(rows)
