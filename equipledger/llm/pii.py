"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import table

# kinds in the order of ties; the first four are the base kinds, which stay whatever their score
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
MIN_SCORE = 0.5        # of the kinds beyond the base
CONTEXT_CHARS = 40     # on either side of a span

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run that failed from its first digit fails from any other, so a match never starts inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
# characters of an IBAN by country (ISO 13616)
IBAN_CHARS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}

# start score of a kind, and the words near a span that raise or lower it: beyond the base kinds they decide. An IBAN stays
# unless words speak against it alone, a social security number needs a word for it.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "correo", "kontakt", "courriel"},
    "ip": {"ip", "address", "server", "host", "login", "adresse"},
    "card": {"card", "credit", "visa", "mastercard", "pay", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {
    "email": {"example", "noreply"}, "ip": {"version", "release", "v"}, "card": {"isbn", "serial", "order", "tracking"},
    "phone": {"isbn", "version"}, "iban": {"serial", "model"}, "ssn": {"part", "serial", "order", "isbn"},
}
_WORD = re.compile(r"[^\W_](?:[\w-]*[^\W_])?")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the rearranged number leaves 1 modulo 97."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern scanned from the left, but started from each @, so that long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal runs on over blanks, so its end is tried at every group edge: the country's length first, then the
    longest. After a span the scan goes on behind it, after a failure at the next group."""
    m = _IBAN.search(text)
    while m:
        a, whole = m.start(), m[0]
        ends = [len(whole), *[i for i in range(len(whole) - 1, 0, -1) if whole[i] == " "]]
        own = IBAN_CHARS.get(whole[:2])
        ends.sort(key=lambda z: len(whole[:z].replace(" ", "")) != own)      # stable: the others stay longest first
        z = next((z for z in ends if mod97(whole[:z])), None)
        if z:
            yield a, a + z
        m = _IBAN.search(text, a + (z or 1))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, z in _emails(text):
            yield "email", a, z
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for a, z in _ibans(text):
        yield "iban", a, z
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for part in (text[max(0, start - CONTEXT_CHARS):start], text[end:end + CONTEXT_CHARS])
            for w in _WORD.findall(part)}
    return min(1.0, max(0.0, START[kind] + 0.3 * bool(near & CONTEXT[kind]) - 0.3 * bool(near & AGAINST[kind])))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind; code points, end exclusive. Null or empty: none."""
    if not text:
        return []
    out = []
    for kind, a, z in _proposals(text):
        s = score(text, kind, a, z)
        if KINDS.index(kind) < BASE or s >= MIN_SCORE:
            out.append((kind, a, z, s))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans go as one, named by the
    first. Text without spans (and null) comes back as it is."""
    spans, runs = find_spans(text), []
    for kind, a, z, _ in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], z)
        else:
            runs.append([kind, a, z])
    if not runs:
        return text
    out, at = [], 0
    for kind, a, z in runs:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = z
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every row, repeated rows included; null or empty text has an empty list."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked and ``n_chars`` (if there) counted anew; same rows, same
    columns. Only ``text`` goes through Python; null text stays null."""
    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: masked(t) if isinstance(t, str) else None)

    out = docs.withColumn("text", mask.asNondeterministic()("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out


def _scores(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 1)), ",")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the contract; ``scores`` has one number a span, in the order of ``spans``."""
    d = with_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:BASE]))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", *[count(k) for k in KINDS[:BASE]], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                    _joined(F.col("spans")).alias("spans"), _scores(F.col("spans")).alias("scores"))
