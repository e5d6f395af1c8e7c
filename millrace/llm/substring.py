"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is what follows a word's place in a text. Suffixes that share their
first ``window`` words or more repeat each other; in the tree of all suffixes
they hang below one internal node of that depth. The tree is never built whole:

1. Sieve. Each window has an anchor, the run of ANCHOR words in it with the
   least hash; equal windows have equal anchors. Only suffixes whose anchor
   occurs in two rows or more can repeat, and only they go on.
2. Partition. A suffix goes to the group named by the shortest of its prefixes
   that isn't frequent: its anchor's words; if those are frequent, its own first
   words, and, if those are, its whole window. Frequent prefixes are counted by
   tasks in a sample of texts, which steers sizes only: any suffix has its group,
   and suffixes with equal windows share it. Suffixes of one anchor travel
   together, as the run of words that they cover, coded by a dictionary.
3. Trees. A group's suffixes are ordered by prefix doubling: ranks by 1, 2, 4, ...
   words, each from the ranks before. The ranks also give the lengths of the
   common prefixes of neighbours, the depths of the tree's internal nodes. A
   suffix repeats up to the depth of the deepest node it hangs below, of at least
   ``window`` words, that has a smaller doc_id below it. Repeats that lie in
   another are dropped; those of a text that overlap are joined, so that repeats
   longer than a group's runs of words come out whole.

Work is done twice over, first among the rows of a task, then among tasks, with
the same trees: a passage that a third of all documents share reaches its group
once a task. What groups find goes back packed by destination.

Words are compared as 64-bit hashes.

Null and empty texts have no words. Among rows with one doc_id none is earlier.
A null doc_id counts as later than any other. Repeated rows each get their result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.common import freed, map_slices, mix, ngram_hashes, pack_ints, shipped, slices, stored, unpack_ints, word_hashes

WINDOW, ANCHOR = 13, 5
#: Anchors, or words of texts with candidates, that a task holds before it sorts and passes them on.
HELD_ANCHORS, HELD_WORDS = 2_000_000, 3_000_000
#: Bytes of text for each group of anchors or suffixes.
GROUP_BYTES = 24 << 20
#: Texts in the sample that finds frequent prefixes, and more of them for each group; a prefix is frequent with more than this part of a group.
SAMPLE, SAMPLE_MORE, FREQUENT = 2000, 50, 1 / 4
_LAST = (1 << 63) - 1
_INDEX = np.uint64((1 << 20) - 1)


def anchors(h: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs of ``size`` words, and for each window the place of its anchor."""
    if len(h) < window:
        return h[:0], np.zeros(0, np.int64)
    g = ngram_hashes(h, size)
    place = np.arange(len(g), dtype=np.uint64)
    low, covers, width = (g & ~_INDEX) | (place & _INDEX), 1, window - size + 1
    while covers < width:  # the minimum over twice as many, up to the width
        step = min(covers, width - covers)
        low = np.minimum(low[:-step], low[step:])
        covers += step
    start = place[: len(low)]
    return g, (start + ((low - start) & _INDEX)).astype(np.int64)


def _words(texts: list) -> list[np.ndarray]:
    """Each text's word hashes."""
    h, ends = word_hashes(texts)
    return np.split(h, ends[:-1])


def _parts(key: np.ndarray):
    """(key, places in order) for each distinct key."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


# ---------------------------------------------------------------- messages

# What goes to a group: places (kind 0) for the rows that hash to it, or kind 1: anchors, or runs of words.
# Entry i stands in row number[i] of (ids, hashes), at place at[i].
_MESSAGE = "grp int, kind int, ids binary, hashes binary, number binary, at binary, more binary, words binary, codes binary"
_NAMES = ("ids", "hashes", "number", "at", "more", "words", "codes")
_PLACES = "grp int, ids binary, hashes binary, number binary, at binary, more binary"


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(arrow), arrow, strict=True)], schema=arrow)


def _rows(ids: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows (ids, a), in order, and each entry's number among them."""
    order = np.lexsort((a, ids))
    i, h = ids[order], a[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (h[1:] != h[:-1])])[: len(i)]
    number = np.empty(len(i), np.int64)
    number[order] = np.cumsum(new) - 1
    return i[new], h[new], number


def _packed_places(groups: int, ids: np.ndarray, a: np.ndarray, at: np.ndarray, more: np.ndarray):
    """(destination, packed columns) of places, by destination, a hash of their row."""
    for g, part in _parts((mix(a.view(np.uint64)) % np.uint64(groups)).astype(np.int64)):
        rows, hashes, number = _rows(ids[part], a[part])
        order = np.lexsort((at[part], number))
        part, number = part[order], number[order]
        yield g, (pack_ints(rows), pack_ints(hashes), pack_ints(np.diff(number, prepend=0)), pack_ints(at[part]), pack_ints(more[part]))


def _met(table: pa.Table, schema: pa.Schema, groups: int, entries) -> pa.Table:
    """A group's places, passed on, and those that ``entries(messages)`` finds, packed by destination."""
    rows = [(r["grp"], r["ids"], r["hashes"], r["number"], r["at"], r["more"]) for r in table.filter(pa.compute.equal(table["kind"], 0)).to_pylist()]
    if messages := table.filter(pa.compute.equal(table["kind"], 1)).to_pylist():
        rows += [(g, *packed) for g, packed in _packed_places(groups, *entries(messages))]
    return pa.Table.from_batches([_batch(schema, rows)])


def _by_row(places: DataFrame) -> DataFrame:
    """id, a, at, more: a row's places, sorted, and what each repeats beyond the window; both int32 as bytes."""
    kind = StructType.fromDDL("id bigint, a bigint, at binary, more binary")
    arrow = to_arrow_schema(kind)

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.to_pylist():
            number = np.cumsum(unpack_ints(r["number"]))
            parts.append((unpack_ints(r["ids"])[number], unpack_ints(r["hashes"])[number], unpack_ints(r["at"]), unpack_ints(r["more"])))
        ids, a, at, more = (np.concatenate([p[i] for p in parts]) for i in range(4))
        ids, a, number = _rows(ids, a)
        order = np.lexsort((-more, at, number))
        number, at, more = number[order], at[order].astype(np.int32), more[order].astype(np.int32)
        first = np.concatenate([[True], (number[1:] != number[:-1]) | (at[1:] != at[:-1])])[: len(at)]
        number, at, more = number[first], at[first], more[first]
        cut = np.searchsorted(number, np.arange(len(ids) + 1))
        return pa.Table.from_batches([_batch(arrow, [(i, h, at[x:y].tobytes(), more[x:y].tobytes()) for i, h, x, y in zip(ids.tolist(), a.tolist(), cut[:-1].tolist(), cut[1:].tolist())])])

    return places.groupBy("grp").applyInArrow(merge, kind)


# ---------------------------------------------------------------- sieve


def _sieve(docs: DataFrame, groups: int, window: int, size: int) -> DataFrame:
    """Places of anchors that occur in two rows or more. The keys of anchors are cut to 48 bits: too many candidates do no harm."""
    shipped(docs.sparkSession)
    kind, places = StructType.fromDDL(_MESSAGE), StructType.fromDDL(_PLACES)
    arrow, out_schema = to_arrow_schema(kind), to_arrow_schema(places)

    def run(batches):
        ids, a, keys, at, sizes, n = [], [], [], [], [], 0

        def flush():
            i, h = np.array(ids, np.int64), np.array(a, np.int64)
            k, p, r = np.concatenate(keys), np.concatenate(at), np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(k, kind="stable")  # rows stay in order within a key
            k, r, p = k[order], r[order], p[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            run = np.cumsum(first) - 1
            last = np.append(np.flatnonzero(first)[1:], len(k)) - 1
            many = (r[first] != r[last])[run]
            none = np.zeros(int(many.sum()), np.int64)
            rows = [(g, 0, *packed, None, None) for g, packed in _packed_places(groups, i[r[many]], h[r[many]], p[many], none)]
            sent = np.flatnonzero(first | ~many)  # a key of one row: each of its places stands in other words
            for g, part in _parts((mix(k[sent]) % np.uint64(groups)).astype(np.int64)):
                part = sent[part]
                own, number = np.unique(r[part], return_inverse=True)
                key = k[part]
                rows.append((g, 1, pack_ints(i[own]), pack_ints(h[own]), pack_ints(number), pack_ints(p[part]), None, pack_ints(np.diff(key, prepend=np.uint64(0))), None))
            return _batch(arrow, rows)

        for batch in batches:
            for id_, a_, texts in slices(batch, 2):
                for j, h in enumerate(_words(texts)):
                    g, place = anchors(h, window, size)
                    if not len(place):
                        continue
                    place = place[np.concatenate([[True], place[1:] != place[:-1]])]  # anchors move to the right
                    keys.append(g[place] >> np.uint64(16))
                    at.append(place)
                    sizes.append(len(place))
                    ids.append(id_[j])
                    a.append(a_[j])
                    n += len(place)
                    if n >= HELD_ANCHORS:
                        yield flush()
                        ids, a, keys, at, sizes, n = [], [], [], [], [], 0
        if n:
            yield flush()

    def shared(messages: list[dict]):
        """The entries whose key several rows hold, within a message or in several."""
        keys = np.concatenate([np.cumsum(unpack_ints(r["words"], np.uint64), dtype=np.uint64) for r in messages])
        number = [unpack_ints(r["number"]) for r in messages]
        ids, a = (np.concatenate([unpack_ints(r[c])[k] for r, k in zip(messages, number, strict=True)]) for c in ("ids", "hashes"))
        at = np.concatenate([unpack_ints(r["at"]) for r in messages])
        source = np.repeat(np.arange(len(messages)), [len(k) for k in number])
        order = np.argsort(keys, kind="stable")
        k, s = keys[order], source[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        last = np.append(np.flatnonzero(first)[1:], len(k)) - 1
        keep = order[(s[first] != s[last])[np.cumsum(first) - 1]]
        return ids[keep], a[keep], at[keep], np.zeros(len(keep), np.int64)

    return docs.select("id", "a", "text").mapInArrow(run, kind).groupBy("grp").applyInArrow(lambda t: _met(t, out_schema, groups, shared), places)


# ---------------------------------------------------------------- prefixes


def _prefix_lengths(window: int, size: int) -> tuple[int, int]:
    """Words of the prefixes that name a group: of the anchor, and of the suffix itself."""
    return size, size + (window - size) // 2


def frequent_prefixes(docs: DataFrame, groups: int, rows: int, window: int, size: int) -> list[np.ndarray]:
    """Hashes of anchors, and of prefixes of suffixes, that hold more than FREQUENT of a group's part of all: at most groups / FREQUENT of each.

    Tasks count them in a sample of texts that grows with the number of groups; only the frequent ones reach the driver.
    """
    shipped(docs.sparkSession)
    kind = StructType.fromDDL("level int, key bigint, n bigint")
    arrow = to_arrow_schema(kind)
    every = max(1, rows // (SAMPLE + SAMPLE_MORE * groups))
    _, longer = _prefix_lengths(window, size)

    def run(batches):
        held, n = ([], []), 0

        def flush():
            out = []
            for level, parts in enumerate(held):
                key, count = np.unique(np.concatenate(parts), return_counts=True)
                out.append((level, None, int(count.sum())))
                out += [(level, k, c) for k, c in zip(key[count > 1].astype(np.int64).tolist(), count[count > 1].tolist())]
                parts.clear()
            return _batch(arrow, out)

        for batch in batches:
            for (texts,) in slices(batch, 0):
                for h in _words(texts):
                    g, place = anchors(h, window, size)
                    if len(place):
                        held[0].append(g[np.unique(place)])
                        held[1].append(ngram_hashes(h, longer)[: len(place)])
                        n += len(place)
                    if n >= HELD_ANCHORS:
                        yield flush()
                        n = 0
        if n:
            yield flush()

    counted = docs.where(F.pmod(F.xxhash64("id", "a"), F.lit(every)) == 0).select("text").mapInArrow(run, kind).groupBy("level", "key").agg(F.sum("n").alias("n"))
    counted = stored(counted, "substring-prefixes")
    total = dict(counted.where("key is null").select("level", "n").collect())
    out = []
    for level in sorted(total):
        found = counted.where((F.col("level") == level) & F.col("key").isNotNull() & (F.col("n") > max(8, FREQUENT * total[level] / groups))).select("key").collect()
        out.append(np.sort(np.array([r[0] for r in found], np.int64).astype(np.uint64)))
    return out


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which elements of x are in the sorted array."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def prefixes(anchor: np.ndarray, longer: np.ndarray, whole: np.ndarray, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with these hashes of their anchor, first words and whole window: that of the shortest that isn't frequent, and whether the anchor is."""
    out, hot = anchor.copy(), np.zeros(len(anchor), bool)
    if frequent:
        hot = _among(anchor, frequent[0])
        out[hot] = np.where(_among(longer[hot], frequent[1]), whole[hot], longer[hot])
    return out, hot


# ---------------------------------------------------------------- trees


class Tree:
    """The suffixes of a sequence of numbers at some places, in lexicographic order, with the depths of the nodes between neighbours.

    Ranks by 1, 2, 4, ... elements come from each other (prefix doubling); order
    and depths are exact up to 31 elements. ``limit`` is how far each suffix
    goes, at most; no depth is counted beyond it.
    """

    LEVELS = 5
    DEPTH = (1 << LEVELS) - 1

    def __init__(self, codes: np.ndarray, starts: np.ndarray, limit: np.ndarray):
        rank = np.unique(codes, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
        both = lambda rank, at, step: rank[at].astype(np.uint64) << np.uint64(32) | rank[step:][at]
        ranks, every = [], slice(0, len(codes))
        for level in range(self.LEVELS):
            ranks.append(np.concatenate([rank, np.zeros(self.DEPTH, np.uint32)]))  # beyond the end is least
            if level + 1 < self.LEVELS:
                rank = np.unique(both(ranks[-1], every, 1 << level), return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
        self.order = np.argsort(both(ranks[-1], starts, (1 << self.LEVELS - 1) - 1), kind="stable")
        at = starts[self.order]
        a, b, depth = at[:-1], at[1:], np.zeros(max(0, len(at) - 1), np.int64)
        for level in reversed(range(self.LEVELS)):
            depth += (ranks[level][a + depth] == ranks[level][b + depth]).astype(np.int64) << level
        limit = limit[self.order]
        #: Words that a suffix, in order, shares with the one before.
        self.depth = np.concatenate([[0], np.minimum(depth, np.minimum(limit[:-1], limit[1:]))]) if len(at) else depth

    def repeats(self, ids: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes as given: the depth of the deepest node, of window or more, that holds a smaller id (0: none), and whether theirs is the least id below their node of depth window and they are the first of their row there."""
        reach, lead = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        first = np.flatnonzero(self.depth < window)
        size = np.diff(np.append(first, len(ids)))
        some = np.flatnonzero(np.repeat(size > 1, size))  # a suffix alone below its node repeats nothing
        own, depth, at = ids[self.order[some]], self.depth[some], self.order[some]
        found = np.zeros(len(some), np.int64)
        for d in range(int(depth.max(initial=0)), window - 1, -1):
            new = depth < d
            low = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
            found[(found == 0) & (low < own)] = d
        reach[at] = found
        node, places = np.cumsum(depth < window), np.flatnonzero(found == 0)
        places = places[np.lexsort((at[places], rows[at[places]], node[places]))]
        same = (node[places[1:]] == node[places[:-1]]) & (rows[at[places[1:]]] == rows[at[places[:-1]]])
        lead[at] = False
        lead[at[places[np.concatenate([[True], ~same])[: len(places)]]]] = True
        return reach, lead


def maximal(row: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which of the repeats (at, at + reach) of rows aren't inside an earlier one of their row; repeats are in order of row and place."""
    far = np.int64(1) << np.int64(32)
    end = row * far + at + reach
    before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) if len(end) else end
    return end > before


def _repeats(docs: DataFrame, candidates: DataFrame, groups: int, frequent: list[np.ndarray], window: int, size: int) -> DataFrame:
    """Places of windows that also start in a row with a smaller id, and how far the repeat goes on; at least one place for each window and row."""
    shipped(docs.sparkSession)
    kind, places = StructType.fromDDL(_MESSAGE), StructType.fromDDL(_PLACES)
    arrow, out_schema = to_arrow_schema(kind), to_arrow_schema(places)
    _, longer = _prefix_lengths(window, size)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        ids, a, words, at, found, n = [], [], [], [], [], 0

        def flush():
            i, h = np.array(ids, np.int64), np.array(a, np.int64)
            sizes = np.array([len(w) for w in words])
            base = np.concatenate([[0], np.cumsum(sizes)])
            r = np.repeat(np.arange(len(ids)), [len(x) for x in at])
            p = np.concatenate(at)
            stream, start, anchor = np.concatenate(words), base[r] + p, base[r] + np.concatenate(found)
            reach, lead = Tree(stream, start, base[r + 1] - start).repeats(i[r], r, window)
            told = np.flatnonzero(reach)
            told = told[maximal(r[told], p[told], reach[told])]
            rows = [(g, 0, *packed, None, None) for g, packed in _packed_places(groups, i[r[told]], h[r[told]], p[told], reach[told] - window)]
            sent = np.flatnonzero(lead)  # one place for each window and row
            like = np.flatnonzero(~lead & (reach == 0))  # its row will see whether that one repeats
            rows += [(g, 0, *packed, None, None) for g, packed in _packed_places(groups, i[r[like]], h[r[like]], p[like], np.full(len(like), -1))]
            s, anchor = start[sent], anchor[sent]
            key, hot = prefixes(ngram_hashes(stream, size)[anchor], ngram_hashes(stream, longer)[s], ngram_hashes(stream, window)[s], frequent)
            new = np.concatenate([[True], (s[1:] != s[:-1] + 1) | (anchor[1:] != anchor[:-1]) | hot[1:]])[: len(s)]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(s)))
            for g, part in _parts((mix(key[first]) % np.uint64(groups)).astype(np.int64)):
                own, number = np.unique(r[sent[first[part]]], return_inverse=True)
                length = count[part] + window - 1
                index = np.repeat(s[first[part]] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                distinct, codes = np.unique(stream[index], return_inverse=True)
                rows.append((g, 1, pack_ints(i[own]), pack_ints(h[own]), pack_ints(number), pack_ints(p[sent[first[part]]]), pack_ints(count[part]), pack_ints(np.diff(distinct, prepend=np.uint64(0))), pack_ints(codes)))
            return _batch(arrow, rows)

        for batch in batches:
            for id_, a_, packed, wanted in slices(batch, 2):
                for j, h in enumerate(_words([unpack.decompress(z) for z in packed])):
                    mark = np.zeros(len(h), bool)
                    mark[np.frombuffer(wanted[j], np.int32)] = True
                    place = anchors(h, window, size)[1]
                    starts = np.flatnonzero(mark[place])
                    if not len(starts):
                        continue
                    at.append(starts)
                    found.append(place[starts])
                    words.append(h)
                    ids.append(id_[j])
                    a.append(a_[j])
                    n += len(h)
                    if n >= HELD_WORDS:
                        yield flush()
                        ids, a, words, at, found, n = [], [], [], [], [], 0
        if n:
            yield flush()

    def later(messages: list[dict]):
        """The repeats that the tree of a group's runs of words shows."""
        words = [np.cumsum(unpack_ints(r["words"], np.uint64), dtype=np.uint64) for r in messages]
        distinct = np.unique(np.concatenate(words))
        codes = np.concatenate([np.searchsorted(distinct, w)[unpack_ints(r["codes"])] for w, r in zip(words, messages, strict=True)])
        number = [unpack_ints(r["number"]) for r in messages]
        ids, a = (np.concatenate([unpack_ints(r[c])[k] for r, k in zip(messages, number, strict=True)]) for c in ("ids", "hashes"))
        at, count = (np.concatenate([unpack_ints(r[c]) for r in messages]) for c in ("at", "more"))
        run = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        end = np.cumsum(count + window - 1)
        start = (end - count - window + 1)[run] + step
        reach, _ = Tree(codes, start, end[run] - start).repeats(ids[run], run, window)
        keep = np.flatnonzero(reach)
        keep = keep[maximal(run[keep], step[keep], reach[keep])]
        run = run[keep]
        return ids[run], a[run], at[run] + step[keep], reach[keep] - window

    joined = docs.select("id", "a", "z").join(candidates.select("id", "a", "at"), ["id", "a"])
    return joined.select("id", "a", "z", "at").mapInArrow(run, kind).groupBy("grp").applyInArrow(lambda t: _met(t, out_schema, groups, later), places)


def covered(n: int, text: bytes, places: np.ndarray, more: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's n words are covered by a window that starts at one of the places, or up to ``more`` words after it, or at a place with ``more`` below 0 if it equals one that does."""
    starts = _runs(places[more >= 0], more[more >= 0] + 1, n)
    like = places[more < 0]
    if len(like) and starts.any():
        g = ngram_hashes(word_hashes([text])[0], window)
        starts[like[np.isin(g[like], g[starts[: len(g)]])]] = True
    at = np.flatnonzero(starts)
    return _runs(at, np.full(len(at), window), n)


def _runs(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Of n places, those in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return edge.cumsum()[:-1] > 0


def spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, id, a and the text as zstd: less to shuffle."""

    def start():
        pack = zstandard.ZstdCompressor(level=1)
        return lambda d, i, a, t: (d, i, a, [pack.compress((x or "").encode()) for x in t])

    return map_slices(docs, ["doc_id", "id", "a", "text"], "doc_id bigint, id bigint, a bigint, z binary", start, text=3)


def find(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, ``removed`` (maximal spans of words to remove: first, end), n_removed, kept_sha256 for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("doc_id", F.lit(_LAST)).cast("bigint").alias("id"), F.xxhash64("text").alias("a"), "text")
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = int(total // GROUP_BYTES + 1)
    frequent = frequent_prefixes(docs, groups, n, window, anchor)
    spark = docs.sparkSession
    candidates = stored(_by_row(_sieve(docs, groups, window, anchor)), "substring-candidates")
    freed(spark)
    packed = _packed(docs)
    found = stored(_by_row(_repeats(packed, candidates, groups, frequent, window, anchor)), "substring-found")
    freed(spark)
    both = packed.join(found, ["id", "a"], "left")

    def start():
        unpack = zstandard.ZstdDecompressor()

        def step(ids, packed, at, more):
            n, removed, gone, kept = [], [], [], []
            for z, p, m in zip(packed, at, more, strict=True):
                text = unpack.decompress(z)
                words = text.split()
                mask = covered(len(words), text, np.frombuffer(p or b"", np.int32), np.frombuffer(m or b"", np.int32), window)
                n.append(len(words))
                removed.append(spans(mask))
                gone.append(int(mask.sum()))
                left = [w for w, gap in zip(words, mask.tolist(), strict=True) if not gap] if gone[-1] else words
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            return ids, n, removed, gone, kept

        return step

    return map_slices(both, ["doc_id", "z", "at", "more"], "doc_id bigint, n_words bigint, removed array<struct<first:int,end:int>>, n_removed bigint, kept_sha256 string", start)
