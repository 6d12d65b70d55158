"""Amount cells to numbers and numbers to text, as Column expressions. Money is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER, 0).try_cast("double")  # names c once; what is no number gives '', and so null


def _in_parentheses(c: Column) -> Column:
    return c.startswith("(") & c.endswith(")")


def _inside(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))


def _commaless(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def account_amount(c: Column) -> Column:
    """Amounts of account rows: parentheses are no sign here."""
    t = trim(c)
    return F.when(~t.isin("", "-", "N/A"), _number(trim(_commaless(t))))


def cell_amount(c: Column) -> Column:
    """Amounts of statement cells: (x) is -x."""
    t = trim(c)
    plain = _commaless(t)
    signed = F.when(_in_parentheses(plain), F.concat(F.lit("-"), _inside(plain))).otherwise(trim(plain))
    return F.when(~t.isin("", "-", "N/A"), _number(signed))


def note_amount(c: Column) -> Column:
    """Amounts of note and cash-flow cells: dashes are empty, spaces inside a number go."""
    t = trim(c)
    bare = F.replace(_commaless(F.when(_in_parentheses(t), _inside(t)).otherwise(t)), F.lit(" "), F.lit(""))
    value = _number(trim(bare))
    return F.when(~t.isin("", "-", "–", "—"), F.when(_in_parentheses(t), -value).otherwise(value))


def hundred_millions(c: Column) -> Column:
    """In 억, without decimals, negative in parentheses; null is -."""
    v = F.format_number(F.abs(c / 1e8), 0)
    return F.when(c.isNull(), "-").when(c < 0, F.concat(F.lit("("), v, F.lit(")"))).otherwise(v)


def short(c: Column) -> Column:
    """x.x억 from 억 on, else the number; null is None."""
    return F.when(c.isNull(), "None").when(F.abs(c) >= 1e8, F.concat(F.format_number(c / 1e8, 1), F.lit("억"))).otherwise(F.format_number(c, 0))


def same(a: Column, b: Column) -> Column:
    """Equal numbers or both null."""
    close = F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(a), F.abs(b)) * 1e-12
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)
