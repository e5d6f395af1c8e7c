"""Normalised text, transaction ids and features of document text, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.locale import stripped

MONEY = "decimal(18,2)"
# The patterns of amounts, dates and French debit lines in documents.
AMOUNTS = "\\d{1,3}(?:[\\s\u00a0]\\d{3})*[,\\.]\\d{2}|\\d+[,\\.]\\d{2}"
DATES = [(r"(?U)\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "yyyy-MM-dd"), (r"(?U)\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", "dd/MM/yyyy"), (r"(?U)\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b", "dd-MM-yyyy")]
DEBIT_LINE = r"(?iU)pr.lev.\s+(?:sur\s+)?le\s+(\d{1,2})\s+(\S+)\s+(\d{4})\s+((?:\d[\d\s\x{A0}]*)?\d[\d.]*,\d{2})"
# French months; a dot stands where an accent may be garbled.
MONTHS = [r"janv(ier)?\.?", r"f.vr(ier)?\.?", "mars", r"avr(il)?\.?", "mai", "juin", r"juil(let)?\.?", r"ao.t", r"sept(embre)?\.?", r"oct(obre)?\.?", r"nov(embre)?\.?", r"d.c(embre)?\.?"]


def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    if s.isna().all():
        return s
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_description(c: Column, compose: bool = True) -> Column:
    """Lowered, composed (NFC), other characters than letters, digits, marks and _ blanked, blanks collapsed.

    Text within Latin-1 is composed already: the Arrow function gets a null in its
    place, which costs next to nothing, and its text stays in the JVM. With compose
    false the function is left out.
    """
    low = F.lower(c)
    if compose:
        other = F.when(low.rlike(r"[^\x00-\xFF]"), low)
        low = F.coalesce(F.pandas_udf(_nfc, "string")(other), low)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def transaction_id(account: Column, date: Column, amount: Column, description: Column) -> Column:
    """SHA-256 of account, ISO date, amount text and normalised description, joined by |."""
    return F.sha2(F.concat_ws("|", account, F.date_format(date, "yyyy-MM-dd"), amount, description).cast("binary"), 256)


def _amount(c: Column) -> Column:
    return F.replace(F.translate(c, "\u00a0 ", ""), F.lit(","), F.lit("."))


def extract_amount(text: Column) -> Column:
    """The largest amount in a text, null if there is none."""
    hits = F.regexp_extract_all(text, F.lit(AMOUNTS), 0)
    return F.array_max(F.transform(hits, lambda x: F.when(_amount(x).rlike(r"^[0-9]+\.[0-9]{2}$"), _amount(x).try_cast(MONEY))))


def extract_date(text: Column) -> Column:
    """The first ISO date that stands alone, not within other digits or letters, else day/month/year, else day-month-year; an impossible date gives way to the next form."""
    return F.coalesce(*(F.try_to_date(F.nullif(F.regexp_extract(text, p, 0), F.lit("")), f) for p, f in DATES))


def french_month(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(c.rlike(f"(?iU)^{p}$"), i).otherwise(out)
    return out


def debit_line(text: Column) -> tuple[Column, Column]:
    """Date and amount of the first line that announces a direct debit; null if it lacks either."""
    part = lambda k: F.regexp_extract(text, DEBIT_LINE, k)
    date = F.try_to_date(F.concat_ws("-", part(3), french_month(part(2)).cast("string"), part(1)), "yyyy-M-d")
    bare = F.translate(stripped(part(4)), "\u00a0 ", "")
    bare = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    amount = F.when(bare.rlike(r"^[0-9]+\.[0-9]{2}$"), bare.try_cast(MONEY))
    both = date.isNotNull() & amount.isNotNull()
    return F.when(both, date), F.when(both, amount)


def is_barcode_line(line: Column) -> Column:
    """Marks, codes and other lines that name no vendor."""
    tokens = F.split(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), " ")
    loud = lambda t: (F.char_length(t) > 15) & t.rlike(r"(?U)^\p{L}+$") & (t == F.upper(t))
    return (
        (line == "2D-DOC") | (F.char_length(line) <= 2) | line.rlike(r"(?U)^\d+$")
        | ((F.char_length(line) > 40) & ~F.contains(line, F.lit(" "))) | ((F.size(tokens) >= 4) & F.forall(tokens, loud))
    )


def extract_vendor(text: Column) -> Column:
    """The first line that isn't blank or a barcode's, null if there is none."""
    lines = F.transform(F.split(text, r"\R"), stripped)
    return F.get(F.filter(lines, lambda x: (x != "") & ~is_barcode_line(x)), F.lit(0))


def features(text: Column, needs_ocr: Column) -> Column:
    """amount, date, vendor, needs_ocr of a text; without both an amount and a date, 0, null, the vendor and true."""
    debit_date, debit_amount = debit_line(text)
    amount = F.coalesce(debit_amount, extract_amount(text))
    date = F.coalesce(debit_date, extract_date(text))
    both = amount.isNotNull() & date.isNotNull()
    return F.struct(
        F.when(both, amount).otherwise(F.lit(0).cast(MONEY)).alias("amount"), F.when(both, date).alias("date"),
        extract_vendor(text).alias("vendor"), F.when(both, needs_ocr).otherwise(True).alias("needs_ocr"),
    )


def month_sheet(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def archive_name(date: Column, amount: Column, vendor: Column, suffix: Column, longest: int = 120) -> Column:
    """date_amount_vendor.suffix; the vendor is lowered and reduced to word characters, and left out if null or empty."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(vendor), r"(?U)[^\w]", "_"), "^_+|_+$", ""), "_+", "_"), 1, longest)
    return F.concat(F.concat_ws("_", F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("undated")), amount.cast("string"), F.when(vendor != "", slug)), suffix)


def archive_dir(root: str, date: Column, layout: str = "year/month") -> Column:
    base = F.lit(root.rstrip("/"))
    return base if layout == "flat" else F.concat_ws("/", base, F.date_format(date, "yyyy/MM"))


def numbered_name(name: Column, number: Column) -> Column:
    """The name itself for 0, else with _number before its suffix."""
    end = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(number == 0, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit("_"), number.cast("string"), end))
