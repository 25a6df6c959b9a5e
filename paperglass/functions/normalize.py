"""Normalisers of text, numbers, dates and times as Column expressions.

Everything stays in the JVM.  Unicode compatibility forms (NFKC), which Spark has
no function for, are applied once at ingest by ``compose_unicode``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null words, currency marks and names, the plain form of a float.
NULL_WORDS = ("", "null", "none", "n/a", "na", "-", "--")
CURRENCY_SIGNS = "€$£¥₹₽₩₺₱₿"
CURRENCY_CODES = "EUR|USD|GBP|CHF|JPY|CAD|AUD"
CURRENCY_NAMES = {
    "EUR": ("euro", "euros", "€"), "USD": ("dollar", "dollars", "$", "us dollar"), "GBP": ("pound", "pounds", "£", "sterling"),
    "JPY": ("yen", "¥"), "CHF": ("franc", "francs"),
}
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: White space in the sense of Unicode, the space itself last.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000 "
# End of fixed values.


def compose_unicode(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the NFKC form of the named string columns."""
    places = {df.columns.index(c) for c in columns}

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, column in enumerate(batch.columns):
                if k in places:
                    column = pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in column.to_pylist()], column.type)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, schema=batch.schema)

    return df.mapInArrow(composed, df.schema)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: an array of one element binds
    it, where repeating the expression would repeat its work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def single_spaced(c: Column) -> Column:
    """Any run of white space as one space."""
    return F.regexp_replace(F.translate(c, SPACES[:-1], " " * (len(SPACES) - 1)), " {2,}", " ")


def is_null(c: Column, kind: str = "string") -> Column:
    """Whether a value counts as absent: null words for text, empty arrays and
    maps; numbers only when null."""
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    if kind != "string":
        return c.isNull()
    return c.isNull() | F.lower(stripped(c)).isin(*NULL_WORDS)


def text(c: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends; null if nothing is left."""
    inner = single_spaced(F.lower(stripped(c)))
    return F.nullif(F.btrim(inner, F.lit(".,;:!? ")), F.lit(""))


def identifier(c: Column) -> Column:
    """Only a-z and 0-9 of the normalised text."""
    return F.regexp_replace(text(c), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Words of the normalised text; empty for a null."""
    return F.coalesce(F.filter(F.split(text(c), " "), lambda t: t != ""), F.array().cast("array<string>"))


def plain_float(c: Column) -> Column:
    """The number a string spells, by the plain form only."""
    return F.when(F.trim(c).rlike(FLOAT), F.trim(c).try_cast("double"))


def number(c: Column) -> Column:
    """A number in any of the usual notations: signs and codes of currencies,
    per cent, comma or point as the decimal mark."""
    bare = F.regexp_replace(stripped(c), f"[{CURRENCY_SIGNS}]", "")
    bare = F.trim(F.regexp_replace(bare, rf"(?i)^\s*({CURRENCY_CODES})\s*", ""))
    return let(F.trim(F.replace(bare, F.lit("%"), F.lit(""))), _plain_number)


def _plain_number(bare: Column) -> Column:
    comma, point = bare.contains(","), bare.contains(".")
    comma_last = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    no_comma = F.replace(bare, F.lit(","), F.lit(""))
    as_point = F.replace(bare, F.lit(","), F.lit("."))
    single = (F.size(F.split(bare, ",")) == 2) & (F.length(F.substring_index(bare, ",", -1)) <= 2)
    plain = (
        F.when(comma & point & comma_last, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, no_comma)
        .when(comma & single, as_point)
        .when(comma, no_comma)
        .otherwise(bare)
    )
    first = lambda p: F.coalesce(plain_float(p), plain_float(F.regexp_extract(p, r"[0-9.]+", 0)))
    return F.when(bare != "", let(plain, first))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")


def _month(name: Column) -> Column:
    lower = F.lower(name)
    return reduce(lambda done, m: done.when(lower.isin(MONTHS[m], MONTHS[m][:3]), str(m + 1)), range(1, 12), F.when(lower.isin(MONTHS[0], MONTHS[0][:3]), "1"))


def _century(y: Column) -> Column:
    return F.concat(F.when(y.cast("int") >= 69, "19").otherwise("20"), y)


def _numeric_date(s: Column, pattern: str, order: str, short: bool = False) -> Column:
    part = {k: F.regexp_extract(s, pattern, i + 1) for i, k in enumerate(order)}
    made = _date(_century(part["y"]) if short else part["y"], part["m"], part["d"])
    return F.when(s.rlike(pattern), made)


def date(c: Column) -> Column:
    """A date in the usual notations, day before month where both are possible."""
    s = F.regexp_replace(stripped(c), r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\w*,?\s*", "")
    s = F.trim(F.regexp_replace(s, r"(\d+)(st|nd|rd|th)", "$1"))
    return F.when(~F.lower(stripped(c)).isin("", "null", "none", "n/a"), let(s, _any_date))


def _any_date(s: Column) -> Column:
    ways = [_numeric_date(s, rf"^(\d{{4}}){p}(\d{{1,2}}){p}(\d{{1,2}})$", "ymd") for p in ("-", "/")]
    ways += [_numeric_date(s, rf"^(\d{{1,2}}){p}(\d{{1,2}}){p}(\d{{4}})$", "dmy") for p in ("/", "-", r"\.")]
    ways += [_numeric_date(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "mdy")]
    ways += [_numeric_date(s, rf"^(\d{{1,2}}){p}(\d{{1,2}}){p}(\d{{2}})$", "dmy", True) for p in ("/", "-", r"\.")]
    ways += [_numeric_date(s, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "mdy", True)]
    ways += [_numeric_date(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?$", "ymd")]
    named = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    ways += [F.when(s.rlike(named), _date(F.regexp_extract(s, named, 3), _month(F.regexp_extract(s, named, 1)), F.regexp_extract(s, named, 2)))]
    named = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    ways += [F.when(s.rlike(named), _date(F.regexp_extract(s, named, 3), _month(F.regexp_extract(s, named, 2)), F.regexp_extract(s, named, 1)))]
    return F.coalesce(*ways)


def time(c: Column) -> Column:
    """HH:MM of a time; what is no time comes back in upper case."""
    return let(F.upper(stripped(c)), _clock)


def _clock(s: Column) -> Column:
    day = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])(?::(?:[0-5]?[0-9]|6[01]))?$"
    half = r"^(0?[1-9]|1[0-2]):([0-5]?[0-9])(?:(?::(?:[0-5]?[0-9]|6[01]))?\s+|)(AM|PM)$"
    hour = F.regexp_extract(s, half, 1).try_cast("int") % 12 + F.when(F.regexp_extract(s, half, 3) == "PM", 12).otherwise(0)
    pair = lambda h, p: F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(F.regexp_extract(s, p, 2), 2, "0"))
    return F.when(
        s.isNotNull() & ~F.lower(s).isin("", "null", "none", "n/a"),
        F.when(s.rlike(day), pair(F.regexp_extract(s, day, 1), day)).when(s.rlike(half), pair(hour.cast("string"), half)).otherwise(s),
    )


def currency(c: Column) -> Column:
    """Three-letter code of a currency name or sign; else upper case."""
    s = stripped(c)
    named = reduce(lambda done, kv: done.when(F.lower(s).isin(*kv[1]), kv[0]), list(CURRENCY_NAMES.items())[1:], F.when(F.lower(s).isin(*CURRENCY_NAMES["EUR"]), "EUR"))
    return F.when(s != "", named.otherwise(F.upper(s)))


def flat_text(c: Column) -> Column:
    """The flat scorer's form: spaces are collapsed before punctuation goes."""
    return F.regexp_replace(single_spaced(F.lower(stripped(F.coalesce(c, F.lit(""))))), r"(?U)[^\w\s]", "")


def flat_date(c: Column) -> Column:
    """The flat scorer's date as ISO text; what is no date comes back stripped."""
    return let(stripped(F.coalesce(c, F.lit(""))), _flat_date)


def _flat_date(s: Column) -> Column:
    ways = [_numeric_date(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd"), _numeric_date(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "dmy"), _numeric_date(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "mdy"), _numeric_date(s, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "dmy")]
    named = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    ways += [F.when(s.rlike(named), _date(F.regexp_extract(s, named, 3), _month(F.regexp_extract(s, named, 2)), F.regexp_extract(s, named, 1)))]
    named = r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$"
    full = F.lower(F.regexp_extract(s, named, 1)).isin(*MONTHS)
    ways += [F.when(s.rlike(named) & full, _date(F.regexp_extract(s, named, 3), _month(F.regexp_extract(s, named, 1)), F.regexp_extract(s, named, 2)))]
    return F.coalesce(F.date_format(F.coalesce(*ways), "yyyy-MM-dd"), s)


def rate(c: Column) -> Column:
    """The number of a percentage text, with or without its sign."""
    return plain_float(F.regexp_replace(F.trim(c), "%+$", ""))


def tax_rate_text(c: Column) -> Column:
    """A percentage text of any tax rate; fractions below one are shares."""
    s = F.trim(c)
    n = plain_float(s)
    percent = F.when((n > 0) & (n < 1), F.round(n * 100, 2)).otherwise(n)
    whole = percent == F.floor(percent)
    shown = F.when(whole, percent.cast("long").cast("string")).otherwise(F.regexp_replace(percent.cast("string"), r"\.0$", ""))
    return F.when(s.endswith("%"), s).when(n.isNull() | (n == 0), "0%").otherwise(F.concat(shown, F.lit("%")))


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers agree; null if either is."""
    return F.abs(a - b) <= tolerance


def share_text(n: Column, total: Column) -> Column:
    """``n (x.x%)``, or ``0`` of nothing."""
    return F.when(total > 0, F.format_string("%d (%.1f%%)", n.cast("long"), F.lit(100.0) * n / total)).otherwise("0")


def elapsed_text(seconds: Column) -> Column:
    """Hours, minutes and seconds as text."""
    h, m, s = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), seconds % 60
    return F.concat_ws(" ", F.when(h > 0, F.format_string("%dh", h)), F.when(m > 0, F.format_string("%dm", m)), F.format_string("%.2fs", s))


def shortened(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - 3), F.lit("..."))).otherwise(c)


def shown_date(c: Column, style: str | Column = "dd/MM/yyyy") -> Column:
    """An ISO date in another style; anything else unchanged."""
    d = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c).try_cast("date")
    if isinstance(style, str):
        return F.coalesce(F.date_format(d, style), c, F.lit(""))
    styles = ("dd/MM/yyyy", "d MMMM yyyy", "MM/dd/yyyy", "yyyy-MM-dd")
    return F.coalesce(reduce(lambda done, k: done.when(style == k, F.date_format(d, k)), styles, F.when(F.lit(False), "")).otherwise(F.date_format(d, styles[0])), c, F.lit(""))
