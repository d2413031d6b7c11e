import datetime as dt

from pyspark.sql import functions as F

from equipledger.functions import scalars as S


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_add_months_clamps_to_month_end(spark):
    d = lambda s: F.lit(dt.date.fromisoformat(s))
    assert one(spark, S.exploitation_end(d("2024-01-31"), F.lit(1))) == dt.date(2024, 2, 29)
    assert one(spark, S.exploitation_end(d("2024-02-29"), F.lit(12))) == dt.date(2025, 2, 28)
    assert one(spark, S.exploitation_end(d("2024-02-29"), F.lit(None).cast("int"))) is None
    assert one(spark, S.exploitation_end(F.lit(None).cast("date"), F.lit(3))) is None


def test_card_status_and_window(spark):
    as_of = "2024-06-01"
    d = lambda s: F.lit(dt.date.fromisoformat(s))
    assert one(spark, S.card_status(d("2024-05-31"), as_of)) == "expired"
    assert one(spark, S.card_status(d("2024-06-01"), as_of)) == "issued"
    assert one(spark, S.card_status(F.lit(None).cast("date"), as_of)) == "issued"
    assert one(spark, S.within_days(d("2024-06-01"), as_of)) is True
    assert one(spark, S.within_days(d("2024-07-01"), as_of)) is True   # as_of + 30
    assert one(spark, S.within_days(d("2024-07-02"), as_of)) is False  # as_of + 31
    assert one(spark, S.within_days(d("2024-05-31"), as_of)) is False


def test_js_parse_int_round_trim(spark):
    assert one(spark, S.js_parse_int(F.lit("12abc"))) == 12
    assert one(spark, S.js_parse_int(F.lit("3.7"))) == 3
    assert one(spark, S.js_parse_int(F.lit("  -4"))) == -4
    assert one(spark, S.js_parse_int(F.lit("x1"))) is None
    assert one(spark, S.js_parse_int(F.lit(""))) is None
    assert one(spark, S.js_round(F.lit(-2.5))) == -2
    assert one(spark, S.js_round(F.lit(2.5))) == 3
    assert one(spark, S.js_parse_float(F.lit("1.5e1x"))) == 15.0
    assert one(spark, S.js_trim(F.lit("\t 42 \n"))) == "42"


def test_js_or_types(spark):
    assert one(spark, S.js_or(F.lit(""), "d")) == "d"
    assert one(spark, S.js_or(F.lit("0"), "d")) == "0"   # a non-empty string is truthy
    assert one(spark, S.js_or(F.lit(0), 1, numeric=True)) == 1
    assert one(spark, S.js_or(F.lit(5), 1, numeric=True)) == 5


def test_ilike_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("Каска белая",), ("50% off",), ("a_b",), ("axb",), ("back\\slash",)], "s string")
    hit = lambda t: sorted(r.s for r in df.where(S.ilike_contains("s", t)).collect())
    assert hit("КАСКА") == ["Каска белая"]           # Cyrillic case folding
    assert hit("a_b") == ["a_b", "axb"]              # '_' stays a wildcard
    assert hit("50%") == ["50% off"]
    assert hit("\\") == ["back\\slash"]              # a lone backslash is literal, not an error
    assert hit("a\\_b") == ["a_b"]                   # an escaped wildcard is literal


def test_json_merge(spark):
    assert one(spark, S.json_merge(F.lit('{"a":1,"b":{"x":1}}'), F.lit('{"b":2,"c":"z"}'))) == '{"a":1,"b":2,"c":"z"}'
    assert one(spark, S.json_merge(F.lit(None).cast("string"), F.lit('{"b":2}'))) is None
    assert one(spark, S.json_merge(F.lit('{"a":1}'), F.lit(None).cast("string"))) == '{"a":1}'


def test_json_truthy(spark):
    assert one(spark, S.json_truthy(F.lit('{"can_edit":true}'), "can_edit")) is True
    assert one(spark, S.json_truthy(F.lit('{"can_edit":false}'), "can_edit")) is False
    assert one(spark, S.json_truthy(F.lit('{}'), "can_edit")) is False
    assert one(spark, S.json_truthy(F.lit(None).cast("string"), "can_edit")) is False
