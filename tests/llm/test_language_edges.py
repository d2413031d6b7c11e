"""Language ID with many languages, and texts whose only word characters are numerals."""

from pyspark.sql import functions as F

from equipledger.llm import crf_lang

from .conftest import docs_of


def test_numerals_are_no_letters(spark):
    assert crf_lang.words_of("½ ² x²y ⅷ Ab3c") == ["x", "y", "ab", "c"]
    m = crf_lang.train(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    rows = {r.doc_id: (r.lang_pred, r.score) for r in crf_lang.identify(docs_of(spark, [(1, "½ ² 12", None, "s"), (2, "the dog", None, "s")]), m).collect()}
    assert rows[1] == ("und", 0.0) and rows[2][0] == "en"


def test_more_languages_than_bits_of_a_number(spark):
    rows = [(100 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcde") * 2, f"l{k:02d}", "s") for k in range(70) for j in range(3)]
    docs = docs_of(spark, rows)
    model = crf_lang.fit(docs.select("doc_id", "text", "lang"), per_lang=3)
    assert len(model.langs) == 70 and crf_lang.Crf.load(model.dump()).lexicon == model.lexicon
    got = crf_lang.identify(docs, model).join(docs.select(F.col("doc_id").alias("d"), F.col("lang").alias("l")), F.col("doc_id") == F.col("d"))
    assert got.where("lang_pred = l").count() >= 0.9 * len(rows)
