import pytest

from equipledger.llm import pii

DE, GROUPED, FR = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"


@pytest.mark.parametrize("text, want", [
    (f"{GROUPED} BIC COBADEFFXXX", [GROUPED]), (f"{DE} 12 Euro", [DE]), (f"IBAN {GROUPED} EUR 250", [GROUPED]),
    (f"{GROUPED} {FR}", [GROUPED, FR]), (f"AB12 {GROUPED} X", [GROUPED]), (f"{DE} AB12 CD34 EF56 7", [DE]),
    (GROUPED, [GROUPED]), ("DE88370400440532013000 12", []), (f"{DE}12 Euro", []), (f"X{DE}", []),
])
def test_an_iban_is_found_whatever_stands_behind_it(text, want):
    assert [text[a:z] for kind, a, z, _ in pii.find_spans(text) if kind == "iban"] == want


def test_an_iban_before_a_code_is_masked():
    assert "DE89" not in pii.masked(f"pay to {GROUPED} BIC COBADEFFXXX") and "3000" not in pii.masked(f"{DE} 12 Euro")
