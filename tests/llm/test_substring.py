import hashlib

import numpy as np
import pytest

from millrace.llm import substring
from tests.llm.tables import documents, empty, frame


def brute(docs, window):
    last = (1 << 63) - 1
    first, out = {}, []
    split = [((d if d is not None else last), d, (t or "").encode().split()) for d, t, *_ in docs]
    for i, _, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, last), i)
    for i, d, w in split:
        m = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                m[p : p + window] = [True] * window
        out.append((d, len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many groups, frequent prefixes, and little held at a time
        monkeypatch.setattr(substring, "GROUP_BYTES", 2000)
        monkeypatch.setattr(substring, "HELD_ANCHORS", 50)
        monkeypatch.setattr(substring, "HELD_WORDS", 50)
    got = substring.find(frame(spark, extra=True)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(documents(), 13)


def test_an_anchor_in_two_contexts_of_a_row(spark, monkeypatch):
    """Both contexts hold the same five words as their anchor; the second is shared with a row of another flush."""
    monkeypatch.setattr(substring, "HELD_ANCHORS", 1)
    around = lambda c, run: [f"{c}{i}" for i in range(4)] + run + [f"{c}{i}" for i in range(4, 8)]
    runs = ([f"r{n}x{i}" for i in range(5)] for n in range(10_000))
    run = next(r for r in runs if all(substring.anchors(substring._words([" ".join(around(c, r))])[0], 13, 5)[1].tolist() == [4] for c in "ab"))
    docs = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([around("a", run) + [f"z{j}" for j in range(9)] + around("b", run), around("b", run)])]
    got = substring.find(frame(spark, docs)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 13) and sum(r["n_removed"] for r in got) == 13


def test_spans_are_maximal(spark):
    r = {x["doc_id"]: x for x in substring.find(frame(spark)).collect()}
    assert [(s["first"], s["end"]) for s in r[61]["removed"]] == [(0, r[61]["n_words"])] and [(s["first"], s["end"]) for s in r[40]["removed"]] == [(0, len(documents()[3][1].split()))]
    assert substring.find(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    """Order, depths, nodes and reach against all pairs of suffixes; repeats are longer than the window."""
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 3, rng.integers(4, 40)) for _ in range(6)]
    texts.append(texts[0].copy())
    codes, ids, window = np.concatenate(texts), np.repeat([3, 1, 2, 5, 5, 9, 7], [len(t) for t in texts]), 4
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    starts = np.flatnonzero(ends - np.arange(len(codes)) >= window)
    limit = ends[starts] - starts
    tree = substring.Tree(codes, starts, limit)
    own = [tuple(codes[s : s + n].tolist()) for s, n in zip(starts, limit)]
    # Beyond its text's end a suffix runs on, so order is compared within the limits.
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for i, (a, b) in enumerate(zip(tree.order[:-1], tree.order[1:])):
        k = common(own[a], own[b])
        assert tree.depth[i + 1] == min(k, tree.DEPTH) and (k == min(len(own[a]), len(own[b])) or own[a][k] < own[b][k])
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[starts]
    reach, lead = tree.repeats(ids[starts], rows, window)
    for i, s in enumerate(starts):
        best = max((common(own[i], own[j]) for j in range(len(starts)) if ids[starts[j]] < ids[s]), default=0)
        assert (reach[i] >= window) == (best >= window) and reach[i] <= min(best, tree.DEPTH)
        earlier = any(rows[j] == rows[i] and common(own[i], own[j]) >= window for j in range(i))
        assert lead[i] == (best < window and not earlier)
    whole = np.flatnonzero(ids[starts] == 7)[0]  # a copy of the first text
    assert reach[whole] == min(len(texts[0]), tree.DEPTH)


def test_maximal_repeats():
    row, at, reach = np.array([0, 0, 0, 0, 1, 1]), np.array([3, 4, 5, 9, 1, 2]), np.array([15, 14, 14, 13, 13, 13])
    assert substring.maximal(row, at, reach).tolist() == [True, False, True, True, True, True]
    text, places = b"a b c d e a b x", lambda *x: np.array(x, np.int32)
    assert substring.covered(8, text, places(1), places(1), 2).tolist() == [False, True, True, True, False, False, False, False]
    assert substring.covered(8, text, places(0, 5), places(0, -1), 2).tolist() == [True, True, False, False, False, True, True, False]
    assert not substring.covered(8, text, places(5), places(-1), 2).any()


def test_a_long_repeat_is_one_span(spark):
    """A repeat longer than the window and than a group's runs of words comes out of overlapping nodes as one span."""
    passage = [f"p{i}" for i in range(90)]
    docs = [(1, " ".join(["a"] * 3 + passage), "en", "s", 1), (2, " ".join([f"b{i}" for i in range(7)] + passage + ["c"]), "en", "s", 1)]
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in substring.find(frame(spark, docs)).collect()}
    assert got == {1: [], 2: [(7, 97)]}


@pytest.mark.parametrize("n", [5, 12, 13, 14, 300])
def test_anchors(n):
    h = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    h[n // 2 :] = h[: n - n // 2]
    g, at = substring.anchors(h, 13, 5)
    assert len(at) == max(0, n - 12)
    assert all(a <= p <= a + 8 and g[p] == g[a : a + 9].min() for a, p in enumerate(at.tolist()))


def test_groups_follow_frequent_prefixes(spark):
    """A frequent anchor's suffixes are named by their own words, and by the whole window if those are frequent too."""
    run = " ".join(f"r{i}" for i in range(60))
    docs = frame(spark, [(i, f"{run} w{i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1) for i in range(50)]).selectExpr("doc_id as id", "xxhash64(text) as a", "text")
    frequent = substring.frequent_prefixes(docs, 40, 50, 13, 5)
    assert len(frequent) == 2 and len(frequent[0]) and len(frequent[1]) == 60 - 9 + 1
    anchor, longer, whole = frequent[0][:1], frequent[1][:1], np.array([5], np.uint64)
    other = np.array([1], np.uint64)
    assert substring.prefixes(anchor, longer, whole, frequent)[0] == whole and substring.prefixes(anchor, other, whole, frequent)[0] == other
    assert [x[0] for x in substring.prefixes(other, longer, whole, frequent)] == [1, False]
    assert substring.frequent_prefixes(docs.limit(0), 40, 0, 13, 5) == []
