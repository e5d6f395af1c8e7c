import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pitman
from millrace.llm.common import remainder
from tests.llm.tables import documents, empty, frame


def exact(c, others, p, d, theta):
    """The distribution of the number of tables, by enumerating seatings customer by customer."""
    ways = {1: 1.0}
    for n in range(1, c):
        new = Counter()
        for t, w in ways.items():
            new[t] += w * (n - d * t)
            new[t + 1] += w
        ways = new
    weight = {t: w * p**t * math.prod(theta + d * (others + j) for j in range(t)) for t, w in ways.items()}
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


@pytest.mark.parametrize(("c", "others", "p", "d"), [(2, 0, 0.3, 0.5), (6, 4, 0.2, 0.7), (12, 30, 0.9, 0.3)])
def test_tables_are_drawn_from_their_distribution(c, others, p, d):
    n = 40_000
    t = pitman.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, 1.0, np.random.default_rng(1), pitman.log_stirling(d))
    want = exact(c, others, p, d, 1.0)
    for k, q in want.items():
        assert abs((t == k).mean() - q) < 0.015


@pytest.mark.parametrize("d", [0.05, 0.3, 0.6, 0.8, 0.95])
@pytest.mark.parametrize(("c", "others", "p"), [(150, 0, 0.01), (150, 40, 0.3), (600, 2000, 0.05), (600, 0, 0.9), (600, 5, 1e-6)])
def test_many_customers_are_drawn_from_the_same_distribution(c, others, p, d):
    """Beyond EXACT the weights come from other forms; against the recursion's, by the whole distribution function."""
    s, t = pitman.log_stirling(d, c)[c, 1 : c + 1], np.arange(1, c + 1)
    weight = s + t * math.log(p) + np.log(1.0 + d * (others + np.arange(c))).cumsum()
    want = np.exp(weight - weight.max()).cumsum()
    n = 20_000
    got = pitman.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, 1.0, np.random.default_rng(3), pitman.log_stirling(d))
    assert np.abs(np.searchsorted(np.sort(got), t, "right") / n - want / want[-1]).max() < 0.03


def test_very_many_customers():
    """With few of c**d tables, the weight rises by p (r + t) / t, r being strength / discount + others; the mode is p r / (1 - p)."""
    c = np.array([0, 1, 100, 101, 5000, 10**8, 10**10])
    t = pitman.draw_tables(c, np.full(7, 5000), np.full(7, 0.1), 0.5, 1.0, np.random.default_rng(0), pitman.log_stirling(0.5))
    assert t[0] == 0 and t[1] == 1 and (t[2:] >= 1).all() and (t <= c).all()
    assert (np.abs(t[5:] / (0.1 * 5002 / 0.9) - 1) < 0.15).all() and t[2] < t[4] < t[5]


def base(docs):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t, *_ in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens]
    c = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, ws), h in zip(tokens, held)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_base_figures_and_blocks(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(pitman, "BUCKET_BYTES", 20_000)
        monkeypatch.setattr(pitman, "HELD", 500)
    docs = documents() + [documents()[3]]
    out = pitman.score(frame(spark, docs, extra=True), remainder("doc_id", 7) != 2).collect()
    got = sorted(((r["doc_id"], not r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=str)
    assert got == base(docs)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one():
    """Over every word that may follow a context, the unknown one included, in a model of consistent counts."""
    rng = np.random.default_rng(5)
    c = rng.integers(0, 9, (4, 6))  # contexts by words
    t = np.minimum(c, np.maximum(1, c // 2)) * (c > 0)
    cw = t.sum(0)
    tw = np.minimum(cw, 2)
    s = pitman.Scalars(tokens=int(c.sum()), words=6, customers=int(cw.sum()), tables=int(tw.sum()), discount=0.6, parent=0.4)
    parent = pitman._parent(np.append(cw, 0), np.append(tw, 0), s)
    assert parent.sum() == pytest.approx(1)
    for u in range(4):
        own, tables = np.append(c[u], 0), np.append(t[u], 0)
        p = pitman.predictive(own, tables, np.full(7, own.sum()), np.full(7, tables.sum()), parent, s.discount)
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def serial(learn, ask, d, d0, sweeps, burn, rng):
    """The same model by a serial sampler: customers leave and sit down one by one. Scores of the texts asked for."""
    texts = [[None, *t.split(), None] for t in learn]
    pairs = [(u, w) for t in texts for u, w in zip(t, t[1:])]
    words = sorted({w for _, w in pairs}, key=str)
    tables, parent = {}, {}  # (u, w) -> sizes of tables; w -> sizes of the parent's tables
    cu, tu = Counter(), Counter()
    base = 1 / (len(words) + 1)

    def p0(w):
        n, k = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        own = parent.get(w, [])
        return (max(sum(own) - d0 * len(own), 0) + (1 + d0 * k) * base) / (1 + n)

    def sit(sizes, d, rest):
        weight = np.array([max(x - d, 0) for x in sizes] + [rest])
        i = rng.choice(len(weight), p=weight / weight.sum())
        if i == len(sizes):
            sizes.append(1)
        else:
            sizes[i] += 1
        return i == len(sizes) - 1 and sizes[i] == 1

    def rise(sizes):
        i = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def add(u, w):
        cu[u] += 1
        if sit(tables.setdefault((u, w), []), d, (1 + d * tu[u]) * p0(w)):
            tu[u] += 1
            sit(parent.setdefault(w, []), d0, (1 + d0 * sum(map(len, parent.values()))) * base)

    def remove(u, w):
        cu[u] -= 1
        if rise(tables[u, w]):
            tu[u] -= 1
            rise(parent[w])

    total = {}
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep:
                remove(u, w)
            add(u, w)
        if sweep >= burn:
            for t in ask:
                t = [None, *t.split(), None]
                for u, w in zip(t, t[1:]):
                    own = tables.get((u, w), [])
                    total[u, w] = total.get((u, w), 0) + (max(sum(own) - d * len(own), 0) + (1 + d * tu[u]) * p0(w)) / (1 + cu[u]) / sum(1 for x in ask for y in zip([None, *x.split()], [*x.split(), None]) if y == (u, w))
    return [sum(math.log10(total[y] / (sweeps - burn)) for y in zip([None, *t.split()], [*t.split(), None])) for t in ask]


def test_against_a_serial_sampler(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    weight = 1 / np.arange(1, 13)
    learn = [" ".join(rng.choice(words, 12, p=weight / weight.sum())) for _ in range(12)]
    ask = ["", "w0", "w0 w0 w1", "w7 w9 w3", "zzz w0", "w2 zzz", learn[0]]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(learn)] + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(ask)]
    got = {r["doc_id"]: r for r in pitman.score(frame(spark, docs), F.col("doc_id") < 1000, burn=4, keep=10).collect()}
    n1, n2 = (sum(x == k for x in Counter(y for t in learn for y in zip([None, *t.split()], [*t.split(), None])).values()) for k in (1, 2))
    ones = Counter(w for _, w in {y for t in learn for y in zip([None, *t.split()], [*t.split(), None])})
    d, d0 = pitman._discount(n1, n2), pitman._discount(*(sum(x == k for x in ones.values()) for k in (1, 2)))
    want = serial(learn, ask, d, d0, 120, 20, rng)
    for i, t in enumerate(ask):
        assert got[1000 + i]["score"] / (len(t.split()) + 1) == pytest.approx(want[i] / (len(t.split()) + 1), abs=0.05)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("millrace_pairs")]


def test_empty(spark):
    learn = remainder("doc_id", 7) != 2
    assert pitman.score(empty(spark), learn).count() == 0
    r = pitman.score(frame(spark, [(1, None, None, None, None)]), F.lit(True)).first()
    assert (r["n_tokens"], r["train_tokens"]) == (1, 1)
    r = pitman.score(frame(spark, [(1, "a b", None, None, None)]), F.lit(False)).first()
    assert r["train_tokens"] == 0 and r["score"] == pytest.approx(0.0, abs=1e-6)
