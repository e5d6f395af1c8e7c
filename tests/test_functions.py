from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import Locale
from millrace.functions import fuzzy, locale, text


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "v string").select(c.alias("x")).first()["x"]


def each(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_amounts(spark):
    got = each(spark, locale.parse_amount, ["1 234,56", "1 234,5", "-12", ",5", "5,", "1e5", "NaN", "", None, "12,3x", "1_000"])
    assert got == [Decimal("1234.56"), Decimal("1234.5"), Decimal(-12), Decimal("0.5"), Decimal(5), None, None, None, None, None, None]
    dot = Locale(decimal_separator="dot", thousands_separator="comma")
    assert one(spark, locale.parse_amount(F.col("v"), dot), "1,234.56") == Decimal("1234.56")
    assert one(spark, locale.parse_amount(F.col("v")), "1\u202f234,56") is None and one(spark, locale.parse_amount(F.col("v"), Locale(narrow_spaces=True)), "1\u202f234\u00a0567,50") == Decimal("1234567.50")
    assert each(spark, locale.amount_text, ["-0012,50", ",5", "5,", "149,9"]) == ["12.50", "0.5", "5", "149.9"]


def test_stripped(spark):
    """Exactly the characters of Unicode's white space go, at both ends only."""
    every = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000 and i]
    got = each(spark, lambda c: locale.stripped(F.concat(c, F.lit("a"), c, F.lit("b"), c)), every)
    again = each(spark, lambda c: c.rlike(r"(?U)^\s$"), every)
    assert got == [f"a{c}b" if space else f"{c}a{c}b{c}" for c, space in zip(every, again, strict=True)]
    assert {c for c, space in zip(every, again, strict=True) if space} == set(locale.SPACES)


def test_dates(spark):
    assert each(spark, locale.parse_date, ["15/06/2026", "5/6/2026", "31/02/2026", "15/06/26", "2026-06-15", "", None]) == [date(2026, 6, 15), date(2026, 6, 5), None, None, None, None, None]


def test_descriptions_and_ids(spark):
    got = each(spark, text.normalize_description, ["  CARTE  Super-U, n°12 ", "Café _x_", "ÉTÉ", ""])
    assert got == ["carte super u n 12", "café _x_", "été", ""]
    import hashlib

    c = text.transaction_id(F.lit("A"), F.lit("2026-06-15").cast("date"), F.lit("149.90"), F.lit("x"))
    assert one(spark, c, "") == hashlib.sha256(b"A|2026-06-15|149.90|x").hexdigest()


def test_document_features(spark):
    assert each(spark, text.extract_amount, ["Sub 10.00 Tax 5.00 Total 15.00", "Total: 1 234,56 EUR", "none", "15/06/2026 149,90", "Qty 3\n149.90"]) == [Decimal("15.00"), Decimal("1234.56"), None, Decimal("26149.90"), None]
    assert each(spark, text.extract_date, ["on 2026-06-15", "15/06/2026", "15-06-2026", "99/99/2026 then 15-06-2026", "no"]) == [date(2026, 6, 15)] * 4 + [None]
    assert each(spark, text.extract_vendor, ["2D-DOC\n\nab\n123456\n Super U \nx", "", "12", " 2D-DOC1 ", "Facture 2D-DOC Orange"]) == ["Super U", None, None, "2D-DOC1", "Facture 2D-DOC Orange"]
    alone = ["REF 992026-06-1512 facture 2026-06-20", "é2026-06-15 2026-06-16", "x_15/06/2026 (15/07/2026)", "15-06-20261", "2026-06-15T10:00 15/07/2026", "12026-06-15"]
    assert each(spark, text.extract_date, alone) == [date(2026, 6, 20), date(2026, 6, 16), date(2026, 7, 15), None, date(2026, 7, 15), None]
    got = each(spark, lambda c: text.features(c, F.lit(False)), ["EDF\nprélevé le 5 févr. 2026 1 049,90 EUR\n2026-01-01 3,00", "EDF 12,00"])
    assert (got[0]["amount"], got[0]["date"], got[0]["vendor"], got[0]["needs_ocr"]) == (Decimal("1049.90"), date(2026, 2, 5), "EDF", False)
    assert (got[1]["amount"], got[1]["date"], got[1]["needs_ocr"]) == (Decimal(0), None, True)


def test_archive_names(spark):
    c = text.archive_name(F.lit("2026-06-15").cast("date"), F.lit("149.90").cast("decimal(18,2)"), F.col("v"), F.lit(".pdf"))
    assert each(spark, lambda _: c, ["Super U", None, "", "!!"]) == ["2026-06-15_149.90_super_u.pdf", "2026-06-15_149.90.pdf", "2026-06-15_149.90.pdf", "2026-06-15_149.90_.pdf"]
    assert one(spark, text.numbered_name(F.col("v"), F.lit(2)), "a/b.c/x.pdf") == "a/b.c/x_2.pdf"


@pytest.mark.parametrize(("a", "b", "score"), [("Starbucks", "Starbucks Coffee", 72.0), ("SUPER U", "CARTE SUPER U", 70.0), ("Super U", "CARTE SUPER U", 30.0), ("", "", 100.0), ("b a", "a b", 100.0)])
def test_fuzzy(a, b, score):
    assert fuzzy.token_sort_ratio(a, b) == pytest.approx(score)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    assert fuzzy.common_length(a, b) == row[-1]
