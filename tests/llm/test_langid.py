import random

import numpy as np
import pytest

from millrace.llm import langid
from tests.llm.tables import documents, empty, frame

WORDS = {"en": "the of and thing with from house water", "fr": "le de et chose avec depuis maison eau être", "ru": "это дом вода и в на с человек"}


def rows(n=120, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[l].split()) for _ in range(20)), l, "s", 1) for i in range(n) for l in [sorted(WORDS)[i % 3]]]


def test_held_out(spark):
    docs = rows()
    model = langid.learn(frame(spark, docs[:90]))
    assert model.langs == ["en", "fr", "ru"]
    got = langid.identify(frame(spark, docs[90:], extra=True), model).collect()
    truth = {d: l for d, _, l, *_ in docs}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and r["score"] > 0.9 for r in got)


def test_spans_of_mixed_text(spark):
    model = langid.learn(frame(spark, rows()))
    text = " ".join(["the house of water and thing"] * 3 + ["la maison et eau être avec le chose"] * 3 + ["это дом"])
    r = langid.identify(frame(spark, [(1, text, None, None, 1)]), model).first()
    assert [s["lang"] for s in r["spans"]] == ["en", "fr", "ru"] and r["lang_pred"] == "fr"
    assert [(s["first"], s["last"]) for s in r["spans"]][0][0] == 0 and r["spans"][-1]["last"] == len(text.split()) - 1


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_is_best(seed):
    rng = np.random.default_rng(seed)
    s, penalty = rng.normal(size=(7, 3)) * 3, float(rng.uniform(0, 6))
    value = lambda p: s[np.arange(7), p].sum() - penalty * (np.diff(p) != 0).sum()
    best = max(value(np.array(p)) for p in np.ndindex(*[3] * 7))
    assert value(langid.viterbi(s, penalty)) == pytest.approx(best)


def test_awkward_inputs(spark):
    model = langid.learn(frame(spark))
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(frame(spark, extra=True), model).collect()}
    assert {k[0] for k, r in got.items() if k[1] == "und"} == {80, 81, 82, 83} and (87, "ja") in got
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(documents()) >= len(got)
    nothing = langid.learn(empty(spark))
    assert nothing.langs == [] and {r["lang_pred"] for r in langid.identify(frame(spark), nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_features_of_words():
    found, owner = langid.features(["ab", "c"])
    assert sorted(np.bincount(owner).tolist()) == [3, 6] and len(langid.features([])[0]) == 0
    assert langid.script_of("123") == -1 and langid.script_of("é") == langid.script_of("a") != langid.script_of("д")
