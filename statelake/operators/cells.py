"""Spelling-tolerant parsing of dates, amounts and counts as column expressions.

Everything stays inside whole-stage code generation. A text fills a cell if it
states one whole calendar day or one number; everything else gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names and abbreviations.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ABBREVIATIONS = [*[name[:3] for name in MONTHS], "sept"]

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?"
_YMD = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_DOTTED = r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})$"
_DAY_FIRST = r"^(\d{1,2})(?:st|nd|rd|th|\.)?[ -]([a-z]+)\.?,?[ -](\d{4})$"
_MONTH_FIRST = r"^([a-z]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"

_CURRENCY = r"(?:EUR|USD|GBP|CHF|€|\$|£)"
_GROUPED = r"^([1-9]\d{0,2})([ ,.'])(\d{3})((?:\2\d{3})*)(?:(?!\2)[.,](\d{1,2}))?$"
_PLAIN = r"^(\d+)(?:[.,](\d{1,2}))?$"


def tidy(value: Column) -> Column:
    """ASCII digits and marks, every run of blanks as one space, none at the ends, no invisible characters."""
    plain = F.translate(value, FULL_WIDTH, ASCII)
    plain = F.regexp_replace(plain, r"[​-‏⁠﻿­]", "")
    plain = F.regexp_replace(plain, r"(?U)\s+", " ")
    return F.trim(plain)


def _month(name: Column) -> Column:
    """Number of an English month; null for any other word. A position in a text keeps the generated code small, which a map does not."""
    number = F.floor((F.instr(F.lit(" ".join(m[:3] for m in MONTHS)), F.substring(name, 1, 3)) + 3) / 4)
    return F.when(name.isin([*MONTHS, *ABBREVIATIONS]), number.cast("string"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "0000") & month.isNotNull(), text.try_cast("date"))


def parse_date(value: Column) -> Column:
    """The calendar day that ``value`` states, whatever its spelling; a time of day is ignored. Dotted dates put the day first."""
    t = F.lower(tidy(value))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso = F.upper(t)
    return (
        F.when(iso.rlike(_YMD), _day(F.regexp_extract(iso, _YMD, 1), F.regexp_extract(iso, _YMD, 3), F.regexp_extract(iso, _YMD, 4)))
        .when(t.rlike(_COMPACT), _day(part(_COMPACT, 1), part(_COMPACT, 2), part(_COMPACT, 3)))
        .when(t.rlike(_DOTTED), _day(part(_DOTTED, 3), part(_DOTTED, 2), part(_DOTTED, 1)))
        .when(t.rlike(_DAY_FIRST), _day(part(_DAY_FIRST, 3), _month(part(_DAY_FIRST, 2)), part(_DAY_FIRST, 1)))
        .when(t.rlike(_MONTH_FIRST), _day(part(_MONTH_FIRST, 3), _month(part(_MONTH_FIRST, 1)), part(_MONTH_FIRST, 2)))
    )


def _number(body: Column) -> tuple[Column, Column]:
    """Digits before and after the decimal sign of an unsigned number; null, '' if it is none."""
    grouped, plain = body.rlike(_GROUPED), body.rlike(_PLAIN)
    whole = F.when(grouped, F.regexp_replace(F.concat(*[F.regexp_extract(body, _GROUPED, i) for i in (1, 3, 4)]), "[^0-9]", "")).when(plain, F.regexp_extract(body, _PLAIN, 1))
    rest = F.when(grouped, F.regexp_extract(body, _GROUPED, 5)).otherwise(F.regexp_extract(body, _PLAIN, 2))
    return F.coalesce(F.nullif(F.regexp_replace(whole, "^0+", ""), F.lit("")), F.when(whole.isNotNull(), F.lit("0"))), rest


def _signed(value: Column) -> tuple[Column, Column]:
    t = F.translate(value, "’−", "'-")
    return F.when(t.rlike("^-"), "-").otherwise(""), F.regexp_replace(t, "^[+-] ?", "")


def parse_amount(value: Column) -> Column:
    """The amount as ``decimal(38,2)``: currency sign or code, grouping and plus sign are dropped; at most two decimals."""
    bare = F.trim(F.regexp_replace(tidy(value), rf"(?i)^{_CURRENCY} ?|(?<=[0-9]) ?{_CURRENCY}$", ""))
    sign, body = _signed(bare)
    whole, rest = _number(body)
    return F.concat(sign, whole, F.lit("."), F.rpad(rest, 2, "0")).try_cast("decimal(38,2)")


def parse_count(value: Column) -> Column:
    """The whole number as ``decimal(38,0)``; decimals must be zero."""
    sign, body = _signed(tidy(value))
    whole, rest = _number(body)
    return F.when(rest.rlike("^0*$"), F.concat(sign, whole).try_cast("decimal(38,0)"))


PARSERS = {"date": parse_date, "decimal": parse_amount, "integer": parse_count}
