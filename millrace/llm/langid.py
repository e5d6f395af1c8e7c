"""Language identification of spans of mixed-language text.

A word is scored per language by naive Bayes over its byte 2-, 3- and 4-grams
(with word boundaries). The script of its first letter narrows the languages to
those seen with that script. Viterbi over the words of a text, with a penalty
for switching, labels spans; the text's language is that of most words.

The model has a fixed number of n-gram buckets a language, so its size depends
on the number of languages only. Texts that are null, empty or without letters
are ``und`` with score 0; ties go to the language first in order.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_slices, shipped

#: n-gram buckets for each order are 2**BITS.
BITS, ORDERS = 14, (2, 3, 4)
#: Cost, in nats, of a change of language between two words.
SWITCH = 8.0
#: A language is a candidate for a script if so large a share of its words is in it.
SCRIPT_SHARE = 0.001
# First code points of script ranges and their names (Unicode blocks).
SCRIPTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"),
    (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]
_NAMES = sorted({b for _, b in SCRIPTS} - {"none"})
_SCRIPT = [-1 if b == "none" else _NAMES.index(b) for _, b in SCRIPTS]
_MASK = np.uint64(2**BITS - 1)
_K = np.uint64(0x9E3779B97F4A7C15)
_LEAST = -1e4


def script_of(word: str) -> int:
    """The index of the script of the word's first letter; -1 without letters."""
    for c in word:
        if c.isalpha():
            found = _SCRIPT[bisect_right(_STARTS, ord(c)) - 1]
            return found if found >= 0 else _NAMES.index("other")
    return -1


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a list of lower-cased words: n-gram buckets (order by order) and the word each belongs to."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8"), np.uint8)
    blank = data == 32
    owner = np.cumsum(blank) - 1  # of the n-gram that starts at a place
    x = data.astype(np.uint64)
    found, owners = [], []
    h = x.copy()
    for n in range(2, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(257) + x[n - 1 :]
        inner = np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= blank[i : i + m]
        keep = np.flatnonzero(~inner if n > 2 else ~(blank[:m] & blank[1:]))
        if n in ORDERS:
            found.append((((h[keep] * _K) >> np.uint64(64 - BITS)) & _MASK).astype(np.int64) + ORDERS.index(n) * 2**BITS)
            owners.append(owner[keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    #: log-probabilities, n-gram bucket by language
    logp: np.ndarray
    #: whether a language is a candidate for a script
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words by languages) and whether a word has letters, for lower-cased words."""
        found, owner = features(words)
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.logp[found, k], len(words)) / len(ORDERS)
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        has = scripts >= 0
        out[~self.allowed[scripts]] = _LEAST  # index -1: the last row, of words without letters
        out[~has] = 0
        return out, has


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels for word scores s (words by languages)."""
    n, k = s.shape
    total = s.sum(0)
    best = int(total.argmax())
    if k == 1 or n == 1:
        return np.full(n, best)
    # All words in one language is best if no stretch gains more elsewhere than its switches cost.
    other = s.copy()
    other[:, best] = -np.inf
    gain = np.concatenate([[0.0], np.cumsum(other.max(1) - s[:, best])])
    low = np.minimum.accumulate(gain)
    if (gain - low).max() <= 2 * penalty and gain.max() <= penalty and (gain[-1] - gain).max() <= penalty:
        return np.full(n, best)
    back = np.empty((n, k), np.int32)
    v = s[0].copy()
    same = np.arange(k)
    for i in range(1, n):
        top = int(v.argmax())
        switch = v[top] - penalty > v
        back[i] = np.where(switch, top, same)
        v = np.where(switch, v[top] - penalty, v) + s[i]
    path = np.empty(n, np.int64)
    path[-1] = v.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of docs with a language."""

    def start():
        def step(texts, langs):
            counts: dict[str, np.ndarray] = {}
            scripts: dict[str, np.ndarray] = {}
            for name in sorted(set(langs)):
                seen: dict[str, int] = {}
                for t, l in zip(texts, langs, strict=True):
                    if l == name and t:
                        for w in t.lower().split():
                            seen[w] = seen.get(w, 0) + 1
                words, n = list(seen), np.fromiter(seen.values(), np.float64, len(seen))
                if not words:
                    continue
                found, owner = features(words)
                counts[name] = np.bincount(found, n[owner], len(ORDERS) * 2**BITS)
                of = np.fromiter(map(script_of, words), np.int64, len(words))
                scripts[name] = np.bincount(of[of >= 0], n[of >= 0], len(_NAMES))
            return counts, scripts

        return step

    def run(batches):
        import pyarrow as pa

        from millrace.llm.common import slices

        step, total, kinds = start(), {}, {}
        for batch in batches:
            for lists in slices(batch, 0):
                counts, scripts = step(*lists)
                for out, new in ((total, counts), (kinds, scripts)):
                    for name, x in new.items():
                        out[name] = out[name] + x if name in out else x
        for name, x in total.items():
            both = np.concatenate([x, kinds[name]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "i": at.astype(np.int32), "n": both[at].astype(np.int64)})

    shipped(docs.sparkSession)
    known = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    found = known.mapInArrow(run, "lang string, i int, n bigint").groupBy("lang", "i").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    width = len(ORDERS) * 2**BITS
    counts = np.zeros((width + len(_NAMES), len(langs)))
    if langs:
        place = {name: k for k, name in enumerate(langs)}
        counts[found["i"].to_numpy(), [place[name] for name in names]] = found["n"].to_numpy()
    grams = counts[:width].reshape(len(ORDERS), 2**BITS, len(langs)) + 0.5
    logp = np.log(grams / grams.sum(1, keepdims=True)).reshape(width, len(langs))
    scripts = counts[width:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that none was learned with narrows nothing
    return Model(langs, logp, np.vstack([allowed, np.ones(len(langs), bool)]))


_SPANS = "array<struct<first:int,last:int,lang:string>>"


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (the share of words with letters that carry that label) and, if asked for, ``spans`` of words (last inclusive) with one label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m: Model = sent.value

        def step(ids, texts):
            place: dict[str, int] = {}
            split = [t.lower().split() if t else [] for t in texts]
            for words in split:
                for w in words:
                    if w not in place:
                        place[w] = len(place)
            scores, has = m.word_scores(list(place)) if place and m.langs else (None, None)
            langs, share, found = [], [], []
            for words in split:
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words)) if scores is not None else np.zeros(0, np.int64)
                lettered = has[at] if len(at) else np.zeros(0, bool)
                if not lettered.any():
                    langs.append("und")
                    share.append(0.0)
                    found.append([])
                    continue
                path = viterbi(scores[at], penalty)
                n = np.bincount(path[lettered], minlength=len(m.langs))
                langs.append(m.langs[int(n.argmax())])
                share.append(float(n.max() / n.sum()))
                if spans:
                    cut = np.flatnonzero(np.diff(path)) + 1
                    found.append([{"first": int(a), "last": int(b) - 1, "lang": m.langs[path[a]]} for a, b in zip([0, *cut], [*cut, len(path)], strict=True)])
            return (ids, langs, share, found) if spans else (ids, langs, share)

        return step

    return map_slices(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double" + f", spans {_SPANS}" * spans, start)
