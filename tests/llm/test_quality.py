import random

import numpy as np

from millrace.llm import quality
from tests.llm.tables import empty, frame, prose


def rows(n=300):
    rng = random.Random(1)
    out = []
    for i in range(n):
        bad = i % 3 == 0
        t = prose(rng, rng.randint(30, 80))
        out.append((i, (t.upper().replace(" ", "!! ") if i % 2 else " ".join([t.split()[0]] * 60)) if bad else t + ".", "en", "s", 1))
    return out, [(i, 0 if i % 3 == 0 else 1) for i in range(n)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int")


def test_held_out_accuracy(spark):
    docs, marks = rows()
    marks += [(1, 1), (1, None), (None, 0), (9999, 0)]
    model = quality.train(frame(spark, docs), labels(spark, marks), "quality", (3, 1))
    got = quality.scored(frame(spark, docs, extra=True), model).collect()
    right = [r["predicted"] == (0 if r["doc_id"] % 3 == 0 else 1) for r in got]
    assert len(got) == len(docs) and sum(right) / len(right) > 0.97
    kept = quality.accepted(frame(spark, docs, extra=True), model)
    assert kept.columns == frame(spark, docs, extra=True).columns and kept.count() == sum(r["predicted"] for r in got)


def test_walk_equals_single_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, trees=30)
    assert ((m.score(x) >= 0.5) == (y > 0)).mean() > 0.95
    for r in range(20):
        f = m.base
        for t in range(len(m.feature)):
            at = 0
            while m.child[t, at, 0] != at:
                at = m.child[t, at, int(x[r, m.feature[t, at]] > m.threshold[t, at])]
            f += m.value[t, at]
        assert abs(1 / (1 + np.exp(-f)) - m.score(x[r : r + 1])[0]) < 1e-9


def test_awkward_inputs(spark):
    from tests.llm.tables import documents

    docs, marks = rows(60)
    model = quality.train(frame(spark, docs), labels(spark, marks), "quality", (3, 1))
    out = quality.scored(frame(spark, extra=True), model).collect()
    assert len(out) == len(documents()) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(empty(spark), model).count() == 0
    none = quality.train(frame(spark, docs), labels(spark, []), "quality", (3, 1))
    assert {r["score"] for r in quality.scored(frame(spark, docs), none).collect()} == {0.5}
    assert len(quality.statistics(None)) == len(quality.NAMES) and quality.statistics("") == quality.statistics(None)
