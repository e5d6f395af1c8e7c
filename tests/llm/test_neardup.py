import numpy as np
import pytest

from millrace.llm import neardup
from millrace.llm.graph import components
from tests.llm.tables import documents, empty, frame


def brute(docs, size):
    rows = []
    for d, t, *_ in docs:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        rows.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (d, a) in enumerate(rows):
        for j, (e, b) in enumerate(rows[:i]):
            if a and b and (d is not None and d == e or 100 * len(a & b) >= 80 * len(a | b)):
                group[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(a), low.get(find(i)) if a else d) for i, (d, a) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, size):
    got = neardup.group(frame(spark, extra=True), size)
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == brute(documents(), size)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)


def test_representatives(spark):
    df = frame(spark, extra=True)
    kept = neardup.representatives(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {80, 81, 82} <= ids and not ids & set(range(60, 70))
    assert neardup.group(empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Groups without a doc_id, equal rows, and one doc_id with two texts; rows without a set all stay."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = [(None, a, "en", "s", 1)] * 3 + [(1, b, "en", "s", 1), (1, b, "fr", "s", 1), (None, b, "en", "s", 1), (2, c, "en", "s", 1), (2, d, "en", "s", 1)]
    docs += [(None, None, "en", "s", 1)] * 2 + [(3, "", "en", "s", 1)] * 2
    kept = [(r["doc_id"], (r["text"] or "")[:2]) for r in neardup.representatives(frame(spark, docs)).collect()]
    assert [kept.count(x) for x in ((None, "a0"), (1, "b0"), (None, "b0"), (None, ""), (3, ""))] == [1, 1, 0, 2, 2]
    assert len([x for x in kept if x[0] == 2]) == 1 and len(kept) == 7


def test_sketch():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 600).astype(np.uint64)
    other = base.copy()
    other[:60] = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(base), np.unique(other), base[:1], base[:5]]
    s = neardup.sketches(sets)
    assert (s != neardup._FULL).all()  # every coordinate fills, also for one element
    assert abs((s[0] == s[1]).mean() - 540 / 660) < 0.13 and (neardup.sketches(sets[:1])[0] == s[0]).all()
    assert len(np.unique(neardup.band_keys(s))) >= 3 * neardup.BANDS


@pytest.mark.parametrize(("small", "block"), [(64, 2000), (1, 2000), (1, 3)])
def test_outsiders_lose_no_link(spark, monkeypatch, small, block):
    """Chains of documents in which the hub is linked with few members, by pairs and by blocks."""
    import random

    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.random()}"
        docs.append((i, " ".join(w), "en", "s", 1))
    got = neardup.group(frame(spark, docs), 4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(docs, 4)


def test_components(spark):
    node = lambda i: (i * 2654435761 % 2**32).to_bytes(16, "big")
    edges = [(node(i), node(i + 1)) for i in range(0, 40) if i % 10 != 9] + [(node(100), node(100))]
    got = components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    by = {}
    for r in got:
        by.setdefault(bytes(r["label"]), set()).add(bytes(r["node"]))
    assert sorted(map(len, by.values())) == [10, 10, 10, 10] and components(spark.createDataFrame([], "a binary, b binary")).count() == 0
