import hashlib
import random
import re

import pytest

from millrace.llm import decontaminate as dc
from tests.llm.tables import documents, empty, frame


def brute(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + window]), set()).add(str(i))
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10_000, 30])
def test_against_brute_force(spark, block):
    docs = documents()
    items = [(1, " ".join(docs[2][1].split()[:15])), (2, docs[75][1].upper()), (3, "one"), (4, ""), (5, None), (6, docs[75][1]), (10, "of the"), (11, "zz zz zz zz zz zz zz zz zz zz")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.report(frame(spark, extra=True), bench, 10, block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 10)
    kept = dc.clean(frame(spark, extra=True), bench, 10, block)
    assert kept.columns == frame(spark, extra=True).columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(x[0]) for x in brute(docs, items, 10) if not x[5])


def test_offsets_and_empty(spark):
    bench = spark.createDataFrame([(1, "b c d")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "a B, c\nd! e")], "doc_id bigint, text string")
    r = dc.find(df, bench, 3).first()
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(2, 8)] and r["items"] == ["1"]
    assert dc.report(empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in dc.report(df, none).collect())


def test_one_item_id_in_many_blocks(spark):
    """Items of one id, each with windows of its own, in blocks of three words: all their hits count, and the id once; a null id is not listed."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(7, " ".join(words[i : i + 3])) for i in range(0, 30, 5)] + [(8, " ".join(words[31:34])), (8, " ".join(words[32:35]))]
    docs = [(i, " ".join(words[rng.randrange(30) :]), "en", "s", 1) for i in range(20)] + [(None, " ".join(words), "en", "s", 1)] * 2
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.blocks_of(bench, 3)[1] >= 8
    got = dc.report(frame(spark, docs), bench, 3, 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)
    null = spark.createDataFrame([(None, "w1 w2 w3")], "item_id bigint, text string")
    r = dc.report(frame(spark, docs[-1:]), null, 3).first()
    assert (r["n_hit"], r["n_items"], r["items_sha256"]) == (3, 0, hashlib.sha256(b"").hexdigest())
