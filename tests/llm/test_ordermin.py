import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import ordermin
from tests.llm.tables import documents, empty, frame


@pytest.mark.parametrize("rows", [2000, 7])
def test_edits_and_neighbours(spark, monkeypatch, rows):
    monkeypatch.setattr(ordermin, "RANGE_ROWS", rows)
    seen = {}
    for d, t, *r in documents():
        if d is not None:
            seen.setdefault(d, (d, t, *r))
    docs = list(seen.values())
    got = {r["doc_id"]: r for r in ordermin.report(frame(spark, docs, extra=True)).collect()}
    ids = sorted(seen, reverse=True)
    for i, d in enumerate(ids):
        text, after = seen[d][1] or "", seen[ids[(i + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (text == edited)
    assert len({got[d]["fingerprint"] for d in range(60, 70)}) == 1 and got[62]["near_next"] == 1.0


def test_ranges(spark):
    """The range of a doc_id is the number of bounds below it, for many bounds and ties with them."""
    bounds = [7 * i - 30_000 for i in range(9_000)]
    ids = [*range(-30_010, 33_010, 997), *bounds[::1234], bounds[0], bounds[-1], -(1 << 62), 1 << 62, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", ordermin._range_of(F.col("i"), bounds).alias("r")).collect()
    assert [r["r"] for r in rows] == [-1 if i is None else sum(b < i for b in bounds) for i in ids]


def test_plan_is_native(spark):
    plan = ordermin.report(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def marks(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["f"] for r in ordermin.with_fingerprint(df, "t", "f").orderBy("i").collect()]


def test_occurrences_and_order(spark):
    import random

    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    close = list(words)
    close[7] = "other"
    turned = words[200:] + words[:200]
    mixed = words[:]
    rng.shuffle(mixed)
    a, b, c, d, e, f, g, h = marks(spark, [" ".join(x) for x in (words, close, turned, mixed, ["a"] * 50, ["a"] * 51)] + ["", "a"])
    like = lambda x, y: len(set(x) & set(y)) / len({v >> 34 & 63 for v in x} | {v >> 34 & 63 for v in y})
    assert like(a, b) > 0.9 and 0.3 < like(a, c) < 0.75 and like(a, d) < 0.1
    assert e != f and 0.5 < like(e, f) and g != h and len(g) == 1
    assert all(len(x) <= 64 for x in (a, b, c))


def test_awkward_inputs(spark):
    assert ordermin.report(frame(spark, extra=True)).count() == len(documents())
    assert ordermin.report(empty(spark)).count() == 0
    one = ordermin.report(frame(spark, [(7, "ab c", None, None, None)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert len(set(map(tuple, marks(spark, ["漢字文書", "漢字文章"])))) == 2
