"""A quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` describes a whole text by numbers that need nothing else of the
row. ``fit`` grows trees on a bounded, documented sample of labelled rows on the
driver; ``Trees`` holds them flattened into arrays, and all trees of a slice are
walked together in numpy.

Null and empty texts have the statistics of the empty text and get a score like
any other. Without labelled rows of both classes the score is the labelled share
of class 1 (0.5 without any). A document labelled more than once counts once,
with the rounded mean label; null labels and null doc_ids teach nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import map_slices, remainder

#: At most so many labelled rows, those with the least hash of doc_id, are learned from.
SAMPLE = 20_000
NAMES = (
    "chars words word_length upper digit punctuation exclaim symbols bars space newline non_ascii distinct_words top_word repeated_neighbour "
    "repeated_line line_length longest_line ended_words short_words long_words sentence_end top3_words distinct_pairs hex_like compression"
).split()
_CLASS = np.zeros((256, 9), np.float64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = [65 <= _c <= 90, 48 <= _c <= 57, _c < 128 and not _ch.isalnum() and _c > 32, _ch == "!", _ch in "#$%&*@^~<>", _ch == "|", _c in (9, 10, 11, 12, 13, 32), _c == 10, _c >= 128]
#: The compressibility is that of a whole text, block by block.
_BLOCK = 1 << 16


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8")
    n = max(1, len(raw))
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64) @ _CLASS / n
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_lengths = [len(x) for x in lines] or [0]
    packed = sum(len(zlib.compress(raw[i : i + _BLOCK], 1)) for i in range(0, len(raw), _BLOCK))
    return [
        np.log1p(len(text or "")), np.log1p(len(words)), float(lengths.mean()) if words else 0.0, *classes,
        len(counts) / k, (top[0] if top else 0) / k, sum(map(eq, words, words[1:])) / k,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(sum(line_lengths) / len(line_lengths)), np.log1p(max(line_lengths)),
        sum(w[-1] in b".,;:!?" for w in words) / k, float((lengths <= 3).sum()) / k, float((lengths >= 14).sum()) / k,
        sum(x.rstrip()[-1] in b".!?" for x in lines) / max(1, len(lines)), sum(top) / k, len(set(zip(words, words[1:]))) / k,
        sum(w.isalnum() and not w.isalpha() and not w.isdigit() for w in counts) / k, packed / n,
    ]


@dataclass
class Trees:
    """Flattened trees: row t of each array is a tree, column i a node; a leaf leads to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, walking all trees of all rows together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), tree.shape[1]), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[tree, at]] > self.threshold[tree, at]
            at = self.child[tree, at, right.astype(np.int64)]
        return 1 / (1 + np.exp(-(self.base + self.value[tree, at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boosted trees with logistic loss; splits are sought in histograms of ``bins`` quantile bins."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    empty = Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes, 2), np.int64), np.zeros((0, nodes)), depth)
    if len(y) < 2 or y.min() == y.max():
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64)
    f = np.full(n, base)
    out = ([], [], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        child = np.repeat(np.arange(nodes)[:, None], 2, 1)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain, split = np.full(count, 1e-9), np.full((count, 2), -1)
            inside = at >= first
            node, rows = at[inside] - first, np.flatnonzero(inside)
            if not len(rows):
                break
            gr, hr = g[rows], h[rows]
            for j in range(width):
                key = node * bins + binned[rows, j]
                gs = np.bincount(key, gr, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(key, hr, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                won = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                won[(hs < least) | (ht - hs < least)] = 0
                best = won.argmax(1)
                better = won[np.arange(count), best] > gain
                gain[better] = won[np.arange(count), best][better]
                split[better] = np.stack([np.full(count, j), best], 1)[better]
            for k in np.flatnonzero(split[:, 0] >= 0):
                i, j, b = first + k, *split[k]
                if b >= len(edges[j]):
                    continue
                feature[i], threshold[i], child[i] = j, edges[j][b], (2 * i + 1, 2 * i + 2)
                mine = at == i
                at[mine] = 2 * i + 1 + (binned[mine, j] > b)
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value = -rate * gs / (hs + ridge)
        f += value[at]
        for a, b in zip(out, (feature, threshold, child, value), strict=True):
            a.append(b)
    return Trees(base, *(np.stack(a) for a in out), depth)


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents whose crc32 of doc_id, modulo held_out[0], isn't held_out[1]."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", held_out[0]) != held_out[1]))
        .groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def start():
        return lambda ids, texts, y: (ids, y, [statistics(t) for t in texts])

    rows = map_slices(known, ["doc_id", "text", "y"], "doc_id bigint, y double, x array<double>", start).toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = np.array(rows["x"].to_pylist())[order]
    y = rows["y"].to_numpy()[order]
    tied = np.lexsort((*x.T, rows["doc_id"].to_numpy()[order]))  # so that repeated doc_ids come in one order too
    return fit(x[tied], y[tied])


def _scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs' columns as c0, c1, ..., then score (double) and predicted (int)."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with ours
    at = docs.columns.index("text")
    mine = docs.toDF(*names)
    schema = StructType([*mine.schema, *StructType.fromDDL("score double, predicted int")])

    def start():
        model = sent.value

        def step(*columns):
            p = model.score(np.array([statistics(t) for t in columns[at]], np.float64))
            return *columns, p.tolist(), (p >= 0.5).astype(np.int32).tolist()

        return step

    return map_slices(mine, names, schema, start, text=at)


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (double) and predicted (int) for every row of docs."""
    return _scored(docs.select("doc_id", "text"), trees).select(F.col("c0").alias("doc_id"), "score", "predicted")


def accepted(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of docs, with its columns, that are predicted to be of class 1."""
    out = _scored(docs, trees).where("predicted = 1")
    return out.select(*out.columns[:-2]).toDF(*docs.columns)
