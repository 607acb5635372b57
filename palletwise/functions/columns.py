"""Column -> Column helpers.

All of them are built from native Spark expressions, so they stay inside
whole-stage codegen and are pushed through the optimizer like any other
projection.  No Python runs per row.
"""

from __future__ import annotations

import datetime as _dt
import functools
import json
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from palletwise.functions.constants import (
    MISSING_TEXT,
    NA_TOKENS,
    NO_DATE,
    REPORT_DESC_WIDTH,
    UNDERSCORE_NUM_RE,
)

__all__ = [
    "as_col",
    "strip_ws",
    "null_tokens",
    "null_tokens_sql",
    "quote_name",
    "to_number",
    "currency_to_number",
    "currency_strict",
    "extended_retail",
    "extended_percent",
    "format_item_id",
    "clean_text",
    "strip_zeros",
    "left",
    "ellipsis",
    "money_text",
    "truncate_int",
    "format_order_date",
    "file_ext",
    "file_base",
    "split_ext",
    "file_parts",
    "stamped_name",
    "run_stamp",
    "safe_name",
    "percent_of",
    "ceil_div",
    "exact_sum",
    "exact_total",
]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Whitespace characters trimmed around values, and the
# characters a plain decimal number may consist of.
WS = " \t\n\r\f\u000b"
NUM_CHARS = "0123456789.+-eE" + WS


def strip_ws(c: Column | str) -> Column:
    """Trim leading/trailing whitespace of any kind (spaces, tabs, newlines)."""
    return F.btrim(as_col(c), F.lit(WS))


def _only(c: Column, chars: str) -> Column:
    """True when ``c`` consists of ``chars`` only (a search for a character of
    one class takes half the time of deleting characters)."""
    return ~c.rlike("[^" + re.escape(chars) + "]")


def null_tokens(c: Column | str, tokens=NA_TOKENS) -> Column:
    """Text equal to one of the reader's missing-value tokens becomes null."""
    c = as_col(c)
    return F.when(~c.isin(*tokens), c)


def quote_name(name: str) -> str:
    """Back-quoted identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def null_tokens_sql(expr: str, alias: str, tokens=NA_TOKENS) -> str:
    """``null_tokens`` as SQL text, for projections over hundreds of columns
    (one ``selectExpr`` call instead of several JVM calls per column)."""
    toks = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in tokens)
    return f"CASE WHEN {expr} IN ({toks}) THEN NULL ELSE {expr} END AS {quote_name(alias)}"


def to_number(c: Column | str) -> Column:
    """Lenient numeric coercion: number-like text -> double, anything else -> 0.

    The guard is required: Spark's cast alone accepts ``1d`` / ``1f``
    suffixes, ``inf`` and ``NaN`` which the matched behaviour treats as
    unparsable.  Restricting the text to digits, ``.``, signs, ``e``/``E``
    and surrounding whitespace before the cast accepts exactly the language
    of ``NUM_RE`` (anything else in that alphabet fails the cast), without
    running a regex per row.
    """
    t = as_col(c).cast("string")
    return F.coalesce(F.when(_only(t, NUM_CHARS), t.try_cast("double")), F.lit(0.0))


def currency_to_number(c: Column | str) -> Column:
    """Strip ``$``, ``,`` and spaces, then lenient numeric (bad -> 0)."""
    return to_number(F.translate(as_col(c).cast("string"), "$, ", ""))


def currency_strict(c: Column | str) -> Column:
    """Strip ``$`` and ``,``, then a strict cast: with ANSI mode on (the
    default) a bad value fails the job; null stays null.  Text that only the
    cast would take for a number (``1d``, ``inf``) is bad too."""
    t = strip_ws(F.regexp_replace(as_col(c).cast("string"), r"[$,]", ""))
    return F.when(_only(t, NUM_CHARS), t).otherwise(F.concat(F.lit("not a number: "), t)).cast("double")


def extended_retail(quantity: Column | str, price: Column | str) -> Column:
    return as_col(quantity) * as_col(price)


def extended_percent(retail: Column | str, pct: float) -> Column:
    """The share *paid*: retail x pct/100 (pct=20 keeps 20 %)."""
    return as_col(retail) * F.lit(float(pct) / 100.0)


def format_item_id(c: Column | str) -> Column:
    """Canonical item-id text.

    * null                     -> ``nan``
    * integer text (any size)  -> digits without leading zeros, sign kept
                                  (exact: no float round trip, so ids longer
                                  than 15 digits keep every digit)
    * other number-like text   -> truncated toward zero, exponent expanded:
                                  the point is moved in the digit text, so
                                  no digit is lost at any size
    * anything else, and text
      beyond a double's range  -> unchanged
    """
    raw = as_col(c).cast("string")
    t = strip_ws(raw)
    # underscores between digits are accepted by the float parser being
    # matched; the (rare) pattern check only runs on text containing "_"
    t = F.when(t.contains("_") & t.rlike(UNDERSCORE_NUM_RE), F.translate(t, "_", "")).otherwise(t)
    is_int = t.rlike(r"^[+-]?[0-9]+\z")
    finite = F.abs(t.try_cast("double")) < F.lit(float("inf"))
    # the parts of number text; Spark works out an expression in a branch as
    # often as it is named there, so they are named seldom
    body = F.ltrim(t, F.lit("+-"))
    low = F.lower(body)
    mantissa = F.substring_index(low, "e", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    # an exponent beyond an int leaves a finite number only if that is under 1
    exponent = F.coalesce(F.substring_index(low, "e", -1).try_cast("int"), F.lit(-(1 << 30)))
    shift = F.when(low.contains("e"), F.least(exponent, F.length(digits) + 400)).otherwise(F.lit(0))
    point = F.greatest(F.length(F.substring_index(mantissa, ".", 1)) + shift, F.lit(0))
    plain = F.when(is_int, body).when(_only(t, NUM_CHARS) & finite, F.rpad(digits, point, "0"))
    signed = F.concat(F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.ltrim(plain, F.lit("0")))
    # the first conditions are asked of every row: what they name is worked out once
    bare = F.coalesce(F.nullif(F.ltrim(raw, F.lit("0")), F.lit("")), F.lit("0"))  # of digits alone, the usual id
    return F.when(raw.isNull(), F.lit(MISSING_TEXT)).when(raw.rlike(r"^[0-9]+\z"), bare).otherwise(
        F.coalesce(F.regexp_replace(signed, "^-?$", "0"), raw))


def clean_text(c: Column | str) -> Column:
    """Missing -> empty text, then trimmed."""
    return strip_ws(F.coalesce(as_col(c).cast("string"), F.lit("")))


def strip_zeros(c: Column | str) -> Column:
    """Leading zeros removed for flexible matching (``000`` -> empty)."""
    return F.ltrim(as_col(c), F.lit("0"))


def left(c: Column | str, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def ellipsis(c: Column | str, width: int = REPORT_DESC_WIDTH, missing: str = MISSING_TEXT) -> Column:
    """Cut to ``width`` characters plus ``...`` when longer; missing prints as
    ``nan`` like the report it reproduces."""
    t = F.coalesce(as_col(c).cast("string"), F.lit(missing))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def money_text(c: Column | str) -> Column:
    """``$1,234.50`` (two decimals, thousands separators, sign after ``$``)."""
    return F.concat(F.lit("$"), F.format_number(as_col(c), 2))


def truncate_int(c: Column | str) -> Column:
    """Integer part, toward zero."""
    return as_col(c).cast("long")


def format_order_date(c: Column | str) -> Column:
    """``yyyy-M-d`` (optionally followed by ``T...``) -> ``MM/dd/yyyy``;
    empty or missing -> ``N/A``; anything unparsable is returned unchanged."""
    s = as_col(c).cast("string")
    parsed = F.try_to_timestamp(F.substring_index(s, "T", 1), F.lit("yyyy-M-d"))
    return F.when(s.isNull() | (s == ""), F.lit(NO_DATE)).otherwise(
        F.coalesce(F.date_format(parsed, "MM/dd/yyyy"), s)
    )


def file_ext(c: Column | str) -> Column:
    """Lower-case text after the last dot (whole name when there is no dot)."""
    return F.lower(F.substring_index(as_col(c), ".", -1))


def file_base(c: Column | str) -> Column:
    """Text before the last dot (whole name when there is no dot)."""
    c = as_col(c)
    return F.when(c.contains("."), F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise(c)


def file_parts(c: Column | str) -> Column:
    """struct(base, ext) of a file name: text before / after the last dot,
    the extension lower-cased."""
    return F.struct(file_base(c).alias("base"), file_ext(c).alias("ext"))


def split_ext(c: Column | str) -> tuple[Column, Column]:
    """(root, ext) like ``os.path.splitext``: ext includes the dot; leading
    dots of the last path part do not start an extension."""
    c = as_col(c)
    m = SPLITEXT_RE
    has = c.rlike(m)
    root = F.when(has, F.regexp_extract(c, m, 1)).otherwise(c)
    ext = F.when(has, F.regexp_extract(c, m, 2)).otherwise(F.lit(""))
    return root, ext


# Fixed value: root/extension split of a path (a non-dot character of the
# last path part must precede the last dot).
SPLITEXT_RE = r"^(.*[^./][^/]*?)(\.[^./]*)$"


def run_stamp(ts: _dt.datetime, micros: bool = False) -> str:
    """One stamp per run, computed on the driver, never per row."""
    return ts.strftime("%Y%m%d_%H%M%S_%f" if micros else "%Y%m%d_%H%M%S")


def stamped_name(base: Column | str, stamp: str, ext: Column | str) -> Column:
    """``base_STAMP.ext`` (``ext`` given without the dot)."""
    return F.concat(as_col(base), F.lit("_" + stamp + "."), as_col(ext))


@functools.cache
def _decompositions() -> list[list[str] | None]:
    """Per page of 256 code points: their text in ASCII, which is the ASCII
    characters of the compatibility decomposition; none for a page without
    any."""
    pages: list[list[str] | None] = []
    for start in range(0, sys.maxunicode + 1, 256):
        points = [chr(p) if not 0xD800 <= p <= 0xDFFF else "" for p in range(start, start + 256)]
        plain = [unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in points]
        pages.append(plain if any(plain) else None)
    while pages[-1] is None:
        pages.pop()
    return pages


def ascii_text(c: Column | str) -> Column:
    """Text in ASCII: characters decomposed (accents dropped, ligatures and
    fractions spelt out), all others left out.  A character is looked up by
    its code point, and only in text that is not ASCII as it is."""
    s = as_col(c).cast("string")
    table = F.from_json(F.lit(json.dumps(_decompositions())), "array<array<string>>")

    def plain(x: Column) -> Column:  # a run of ASCII characters or one other
        page = F.get(table, F.shiftright(F.ascii(x), 8))
        return F.when(F.ascii(x) < 128, x).otherwise(F.coalesce(F.get(page, F.ascii(x).bitwiseAND(255)), F.lit("")))

    pieces = F.regexp_extract_all(s, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(F.array_join(F.transform(pieces, plain), ""))


def safe_name(c: Column | str) -> Column:
    """Safe file name: decomposed to ASCII, ``/`` -> space,
    whitespace runs -> ``_``, characters outside ``[A-Za-z0-9_.-]`` dropped,
    leading/trailing ``.`` and ``_`` removed."""
    s = F.translate(ascii_text(c), "/", " ")
    s = F.regexp_replace(strip_ws(s), r"\s+", "_")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_.\-]", "")
    return F.regexp_replace(s, r"^[._]+|[._]+$", "")


def percent_of(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole rounded half-up to 2 places using integer
    arithmetic (exact on the rational value, engine independent); 0 when
    ``whole`` is 0."""
    p, w = as_col(part).cast("long"), as_col(whole).cast("long")
    hundredths = F.floor((p * F.lit(20000) + w) / (w * F.lit(2)))
    return F.when(w > 0, hundredths.cast("double") / F.lit(100.0)).otherwise(F.lit(0.0))


def ceil_div(a: Column | str, b: Column | str | int) -> Column:
    a = as_col(a).cast("long")
    b = F.lit(b) if isinstance(b, int) else as_col(b).cast("long")
    return F.floor((a + b - F.lit(1)) / b).cast("long")


def exact_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order or partitioning: each value is
    fixed to six decimals and summed as ``decimal(38,6)`` (hash aggregation;
    beyond 32 integer digits the job fails under ANSI mode), returned as
    double; 0 when empty.  Values under 5e-7 count as 0."""
    return F.coalesce(F.sum(as_col(c).cast("decimal(38,6)")).cast("double"), F.lit(0.0))


def exact_double_sum(c: Column | str) -> Column:
    """``exact_sum`` of a double column, with the same result.  A value under
    a million is fixed to six decimals by arithmetic on longs, in two parts
    that no number of rows makes overflow; larger ones, and those so near to
    half of the sixth decimal that their text has to tell, go by decimals."""
    v = as_col(c)
    micro = v * F.lit(1e6)
    low = F.floor(micro)
    above = micro - low
    sure = (F.abs(v) < F.lit(1e6)) & (F.abs(above - F.lit(0.5)) > F.lit(1e-3))
    units = low + F.when(above > F.lit(0.5), F.lit(1)).otherwise(F.lit(0))

    def part(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(sure, x)), F.lit(0)).cast("decimal(20,0)")

    whole = part(F.shiftright(units, 20)) * F.expr("1048576BD") + part(units.bitwiseAND(F.lit((1 << 20) - 1)))
    rest = F.coalesce(F.sum(F.when(~sure, v.cast("decimal(38,6)"))), F.expr("cast(0 as decimal(38,6))"))
    return (whole * F.expr("0.000001BD") + rest).cast("double")


def exact_total(c: Column | str) -> Column:
    """Grand total of already aggregated values, exact in 38 digits."""
    return exact_sum(c)
