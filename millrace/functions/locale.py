"""Amounts and dates written in a locale, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import Locale

AMOUNT = "decimal(38,6)"
# The characters that Unicode counts as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
_THOUSANDS = {"space": " ", "dot": ".", "comma": ",", "none": ""}


def stripped(c: Column) -> Column:
    """Without Unicode white space at the ends; null becomes empty."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def plain_amount(c: Column, locale: Locale = Locale()) -> Column:
    """The amount's text with a decimal point and no thousands separators; no-break spaces count as spaces, narrow ones only if the locale says so."""
    text = F.translate(stripped(c), "\u00a0\u202f" if locale.narrow_spaces else "\u00a0", "  ")
    if mark := _THOUSANDS[locale.thousands_separator]:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.replace(text, F.lit(","), F.lit(".")) if locale.decimal_separator == "comma" else text


def parse_amount(c: Column, locale: Locale = Locale()) -> Column:
    """The amount, or null if the text isn't a plain decimal number."""
    text = plain_amount(c, locale)
    return F.when(text.rlike(_NUMBER), text.try_cast(AMOUNT))


def amount_text(c: Column, locale: Locale = Locale()) -> Column:
    """The absolute amount as written: its scale is kept, signs and leading zeros go."""
    text = F.regexp_replace(plain_amount(c, locale), r"^[+-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\.$", ""), r"^0+(?=[0-9])", "")
    return F.when(F.startswith(text, F.lit(".")), F.concat(F.lit("0"), text)).otherwise(text)


def date_pattern(date_format: str) -> str:
    """Spark's pattern for a format of dd, mm and yyyy; days and months may have one digit."""
    return date_format.replace("dd", "d").replace("mm", "M")


def parse_date(c: Column, locale: Locale = Locale()) -> Column:
    """The date, or null if the text isn't one in the locale's format."""
    return F.try_to_date(stripped(c), date_pattern(locale.date_format))
