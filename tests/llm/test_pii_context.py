"""Context decides on the kinds beyond the base, and the query tells every span's score."""

import pytest

from equipledger.llm import pii

IBAN = "DE89370400440532013000"


@pytest.mark.parametrize("text, want", [
    (f"take {IBAN} here", [("iban", 0.7)]),
    (f"bank account {IBAN}", [("iban", 1.0)]),
    (f"serial number {IBAN}", []),
    (f"serial number of the bank {IBAN}", [("iban", 0.7)]),
    (f"serial {'x' * 60} {IBAN}", [("iban", 0.7)]),          # too far away to matter
    ("ssn 123-45-6789", [("ssn", 0.7)]),
    ("123-45-6789", []),
    ("ssn of part 123-45-6789", []),
    ("version 10.0.0.1", [("ip", 0.3)]),                     # a base kind stays whatever its score
])
def test_context(text, want):
    assert [(kind, pytest.approx(s)) for kind, _, _, s in pii.find_spans(text)] == want


def test_the_query_tells_the_scores(spark, tmp_path):
    spark.createDataFrame([(1, f"mail a@b.cd, bank {IBAN}, version 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:5:11,iban:18:40,ip:50:58" and got[1].scores == "1.0,1.0,0.3"
    assert [(got[k].spans, got[k].scores) for k in (2, 3)] == [("", ""), ("", "")]
