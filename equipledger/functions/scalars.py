"""Scalar column functions (all built-in expressions: JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original back end's (status words, defaults, texts).
STATUS_EXPIRED = "expired"
STATUS_ISSUED = "issued"
STATUS_IN_STOCK = "in_stock"
HOLDING_ACTIVE = "active"
HOLDING_RETURNED = "returned"
SOURCE_WAREHOUSE = "warehouse"
SOURCE_EMPLOYEE = "employee"
DEFAULT_UNIT = "шт"
EXPIRING_WINDOW_DAYS = 30
IMPORT_STOCK_NOTE = "Импорт остатков по реестру"
IMPORT_STOCK_DOC_PREFIX = "Импорт остатков "
ADJUST_DEFAULT_NOTE = "Ручная корректировка"


def as_of_col(as_of) -> Column:
    """The reference date replacing CURRENT_DATE; ``None`` means today's UTC date."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def exploitation_end(start: Column | str, months: Column | str) -> Column:
    """Start + months (month-end clamped), NULL when either is NULL."""
    start = F.col(start) if isinstance(start, str) else start
    months = F.col(months) if isinstance(months, str) else months
    return F.when(start.isNotNull() & months.isNotNull(), F.add_months(start, months))


def card_status(end: Column, as_of=None) -> Column:
    """C2: 'expired' when the end date lies before as_of, else 'issued' (also for a NULL end)."""
    return F.when(end < as_of_col(as_of), F.lit(STATUS_EXPIRED)).otherwise(F.lit(STATUS_ISSUED))


def within_days(c: Column, as_of=None, days: int = EXPIRING_WINDOW_DAYS) -> Column:
    """BETWEEN as_of AND as_of + days, both ends included."""
    d = as_of_col(as_of)
    return c.between(d, F.date_add(d, days))


def js_or(c: Column | str, default, numeric: bool = False) -> Column:
    """C4, JS ``a || b``: the default replaces a falsy value -- NULL and '' for text, NULL and 0 for numbers."""
    c = F.col(c) if isinstance(c, str) else c
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(js_falsy(c, numeric), d).otherwise(c)


def js_falsy(c: Column, numeric: bool = False) -> Column:
    """JS falsiness of a request value: NULL, '' (text) or 0 / NaN (numbers). A non-empty string such as
    '0' is truthy."""
    if numeric:
        return c.isNull() | (c == 0) | F.isnan(c.cast("double"))
    return c.isNull() | (c.cast("string") == "")


# White space as ECMAScript defines it (fixed values): Java's \\s knows the ASCII ones only.
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def js_parse_int(s: Column | str, dtype: str = "int") -> Column:
    """C11, JS ``parseInt``: leading (signed) digits, or hex digits after 0x, behind white space. NULL stands for
    NaN, and for a number that ``dtype`` cannot hold."""
    s = (F.col(s) if isinstance(s, str) else s).cast("string")
    sign = F.regexp_extract(s, f"^{JS_SPACE}*(-?)", 1)
    hexa = F.conv(F.regexp_extract(s, f"^{JS_SPACE}*[+-]?0[xX]([0-9a-fA-F]+)", 1), 16, 10)
    digits = F.when(s.rlike(f"^{JS_SPACE}*[+-]?0[xX]"), F.concat(sign, hexa)).otherwise(
        F.regexp_extract(s, f"^{JS_SPACE}*([+-]?[0-9]+)", 1))
    return F.when(digits != "", digits.try_cast(dtype))


def js_parse_float(s: Column | str) -> Column:
    """JS ``parseFloat``: the longest leading decimal literal; NULL stands for NaN."""
    s = F.col(s) if isinstance(s, str) else s
    lit = F.regexp_extract(s.cast("string"), rf"^{JS_SPACE}*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return F.when(lit != "", lit.try_cast("double"))


def js_round(x: Column) -> Column:
    """C12, JS ``Math.round``: halves round up (towards +inf), unlike SQL ROUND."""
    return F.floor(x + F.lit(0.5))


def js_trim(s: Column | str) -> Column:
    """C14, JS ``String.trim``: strips all white space (Spark ``trim`` strips spaces only)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.regexp_replace(s, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def ilike_contains(c: Column | str, text: str) -> Column:
    """``c ILIKE '%text%'`` where %, _ in ``text`` stay wildcards, as in the original.

    A backslash escapes the next character in a LIKE pattern; a lone or final backslash, or one before an
    ordinary character, is taken literally (PostgreSQL's standard-conforming behaviour) instead of raising.
    """
    c = F.col(c) if isinstance(c, str) else c
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            nxt = text[i + 1] if i + 1 < len(text) else None
            if nxt in ("%", "_", "\\"):
                out.append("\\" + nxt)
                i += 2
                continue
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return c.ilike("%" + "".join(out) + "%")


def json_merge(extra: Column | str, patch: Column | str) -> Column:
    """C8, ``extra || patch`` on JSON objects: shallow, right wins; a NULL left side stays NULL.

    Works on text so that any JSON value type survives (``variant`` values); needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    extra = F.col(extra) if isinstance(extra, str) else extra
    patch = F.col(patch) if isinstance(patch, str) else patch
    left = F.from_json(extra, "map<string,variant>")
    right = F.from_json(patch, "map<string,variant>")
    merged = F.to_json(F.map_concat(left, F.coalesce(right, F.create_map().cast("map<string,variant>"))))
    return F.when(extra.isNull(), F.lit(None).cast("string")).otherwise(merged)


def json_truthy(doc: Column | str, key: str) -> Column:
    """C9, ``doc?.[key]`` as a boolean test (the seeds hold booleans only)."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    v = F.try_variant_get(F.try_parse_json(doc), f"$.{key}", "boolean")
    return F.coalesce(v, F.lit(False))


def stable_id(*cols: Column | str) -> Column:
    """Deterministic id from natural key columns (replayable, unlike random UUIDs)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def typed_null(dtype: str) -> Column:
    """A typed NULL literal."""
    return F.lit(None).cast(dtype)
