"""A hierarchical Pitman-Yor language model of word pairs, learned and applied in blocks.

Each context word has a restaurant; their common parent is the restaurant of
single words, whose base is uniform over the V learned words and the unknown one.
A restaurant seats a customer for each time a word follows the context; each
table sends one customer to the parent. Gibbs sampling draws the tables of a word
in a restaurant given everything else, with the seats within them summed out by
generalised Stirling numbers: by their recursion up to EXACT customers, beyond
them by their series and saddle-point form (one distribution; tests compare them).
Predictive probabilities are averaged over the kept sweeps, and a text's score is
the sum of their logarithms.

Texts stay in units, runs of rows of a task; a unit tells each bucket, chosen by
the hash of a pair, its distinct pairs and their counts, and in the end gets back
their probabilities. So a bucket holds a pair once a unit, however often it
occurs, and no pair's occurrences meet in a task. In a sweep all buckets draw at
once, against totals of the sweep before: each sends its sums by word to word
groups, and these, after drawing the parent's tables, send the totals back. So no
context, however frequent, is in one task, and nothing that grows with the corpus
is broadcast or collected: the driver sees a few sums.

Units are named by partition and number, so a task that runs again names its own
alike; input that isn't a plain scan is stored first. Null and empty texts consist of the end token only. Rows are told apart by
their place in the scan, so repeated rows each get their score. A null doc_id is
learned from.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.common import dropped, freed, mix, pack_ints, shared_dir, shipped, slices, stored, unpack_ints, word_hashes

#: Bytes of text for each bucket; tokens that a task gathers before it passes them on.
BUCKET_BYTES, HELD = 20 << 20, 1_000_000
#: Sweeps to forget and sweeps to average over.
BURN, KEEP = 2, 3
#: Concentrations of the context restaurants and of their parent.
STRENGTH = (1.0, 1.0)
#: Up to so many customers, the tables of a word are drawn from their exact distribution.
EXACT = 100
#: Words are hashes of 56 bits; that of the end token, which is also the context of a text's first word, is no word's.
SHORTER, END = np.uint64(8), np.uint64(1)


_z, _u = pack_ints, unpack_ints


def _floats(x: np.ndarray) -> bytes:
    """In single precision, a ten-millionth of a token's score."""
    return pack_ints(x.astype(np.float32).view(np.uint32))


def _of_floats(x: bytes) -> np.ndarray:
    return unpack_ints(x, np.uint32).view(np.float32).astype(np.float64)


def _delta(x: np.ndarray) -> bytes:
    """Sorted integers as differences."""
    return pack_ints(np.diff(x, prepend=x.dtype.type(0)))


def _sum(x: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack_ints(x, kind), dtype=kind)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: row c, column t, for c customers at t tables."""
    s = np.full((most + 1, most + 2), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(most + 2)
    for c in range(1, most):
        stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + s[c]
        s[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], s[c][:-1]]))
    return s[:, : most + 1]


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """Tables of a word with c customers, given the restaurant's other tables and the parent's probability p of the word."""
    t = np.minimum(c, 1).astype(np.int64)
    at = np.flatnonzero(c > 1)
    size = np.minimum(c[at], EXACT)
    order = at[np.argsort(size, kind="stable")]
    sizes = np.minimum(c[order], EXACT)
    cut = np.flatnonzero(np.diff(sizes)) + 1
    for part in np.split(order, cut):
        if not len(part):
            continue
        n = int(min(c[part[0]], EXACT))
        for some in np.array_split(part, max(1, len(part) * n // 2_000_000)):
            weight = np.log(strength + discount * (others[some, None] + np.arange(n)[None, :])).cumsum(1)
            weight += np.arange(1, n + 1)[None, :] * np.log(p[some])[:, None] + stirling[n, 1 : n + 1][None, :]
            weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
            t[some] = (weight < rng.random(len(some))[:, None] * weight[:, -1:]).sum(1) + 1
    large = np.flatnonzero(c > EXACT)
    for some in np.array_split(large, len(large) // 4000 + 1) if len(large) else []:
        t[some] = _draw_many(c[some].astype(float), others[some].astype(float), p[some], discount, strength, rng)
    return t


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Terms of the series of generalised Stirling numbers for few tables.
TERMS = 60


def _few(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers over Gamma(c), for t of up to c**d tables: their alternating series."""
    total, product, last = 0.0, np.ones(np.broadcast_shapes(c.shape, t.shape)), _log_gamma(c)
    factor = 1.0  # Gamma(d j + 1) / j!
    for j in range(1, TERMS + 1):
        now = _log_gamma(np.maximum(c - d * j, 1.0))
        product = product * np.maximum(t - j + 1, 0) * np.exp(now - last)
        last = now
        factor = math.exp(math.lgamma(d * j + 1) - math.lgamma(j + 1))
        total = total + (1 if j % 2 else -1) * math.sin(math.pi * d * j) / math.pi * factor * product
    return np.log(np.maximum(total, 1e-300)) - t * math.log(d) - _log_gamma(t + 1)


def _many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for more tables, up to a constant factor for each c, from the saddle point of their generating function.

    They are c!/t! times the coefficient of x**c in ((1 - (1 - x)**d) / d)**t;
    the saddle is sought as v = -log(1 - x), where the logarithm of the sought
    ratio c/t is convex and increasing, by Newton steps from above.
    """
    goal = np.log(c / t)
    v = np.maximum(np.minimum((goal - math.log(d)) / (1 - d), 2 * goal / (1 - d)), 1e-9)
    for _ in range(8):
        value = np.log(-np.expm1(-v)) + v * (1 - d) + math.log(d) - np.log(-np.expm1(-d * v))
        slope = (1 - d) + 1 / np.expm1(v) - d / np.expm1(d * v)
        v = np.maximum(v - (value - goal) / slope, 1e-9)
    slope = (1 - d) + 1 / np.expm1(v) - d / np.expm1(d * v)
    spread = np.expm1(v) * (c / t) * slope
    return np.log(c) - _log_gamma(t + 1) + t * (np.log(-np.expm1(-d * v)) - math.log(d)) - c * np.log(-np.expm1(-v)) - 0.5 * np.log(2 * math.pi * t * spread)


def log_stirling_at(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers for c customers at t < c tables, over Gamma(c): the series up to c**discount tables, beyond it the saddle-point form, joined there."""
    join = np.maximum(np.floor(c**discount), 1.0)
    few = _few(c, np.minimum(t, join), discount)
    return np.where(t <= join, few, _many(c, np.maximum(t, join), discount) + _few(c, join, discount) - _many(c, join, discount))


#: Numbers of tables that are weighed at once for a word with many customers.
GRID = 48


def _draw_many(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words with many customers: a grid of numbers of tables closes in on those that weigh; between its points the weight is taken as even."""
    d, c, r, p = discount, c[:, None], (strength / discount + others)[:, None], p[:, None]
    t = np.unique(np.floor(np.geomspace(1, c.max(), GRID)))[None, :] * np.ones_like(c)
    step = np.ones_like(c)
    for _ in range(12):
        some = np.minimum(t, c - 1)
        weight = log_stirling_at(c, some, d) + some * (np.log(p) + math.log(d)) + _log_gamma(r + some + 1) - np.log(r + some)
        weight = np.where(t < c, weight, -np.inf)
        weight -= weight.max(1, keepdims=True)
        near = weight > -25
        if _ and np.all((step == 1) & (~near[:, -1:] | (t[:, -1:] >= c - 1)) | (near.sum(1, keepdims=True) > 12)):
            break
        low, high = near.argmax(1) - 1, near.shape[1] - near[:, ::-1].argmax(1)
        first = np.take_along_axis(t, np.maximum(low, 0)[:, None], 1)
        last = np.minimum(np.take_along_axis(t, np.minimum(high, t.shape[1] - 1)[:, None], 1), c - 1)
        step = np.maximum(np.ceil((last - first + 1) / GRID), 1)
        t = first + step * np.arange(GRID)
    share = np.exp(weight).cumsum(1)
    at = np.minimum((share < rng.random((len(c), 1)) * share[:, -1:]).sum(1), t.shape[1] - 1)
    spread = np.floor((rng.random(len(c)) - 0.5) * step[:, 0] + 0.5) if step.max() > 1 else 0
    return np.clip(t[np.arange(len(c)), at] + spread, 1, c[:, 0] - 1).astype(np.int64)


# ---------------------------------------------------------------- tokens to buckets

_PAIRS = "bucket int, unit bigint, words binary, u binary, w binary, c binary"
_TEXTS = "unit bigint, pairs binary, sizes binary, ids binary, info binary"


def _tokens(docs: DataFrame, buckets: int, texts: bool) -> DataFrame:
    """A unit's distinct pairs in a bucket, with learned counts; or, with texts, a unit's texts as numbers of its pairs, which are numbered by bucket.

    Both come from the same scan, done twice, so that texts needn't wait on disk
    for the sweeps. docs has columns id, null (doc_id is null), learn, text.
    """
    shipped(docs.sparkSession)
    kind = StructType.fromDDL(_TEXTS if texts else _PAIRS)
    arrow = to_arrow_schema(kind)

    def run(batches):
        parts, sizes, ids, info = [], [], [], []
        held = units = 0

        def flush():
            unit = TaskContext.get().partitionId() << 32 | units
            n = np.array(sizes, np.int64)
            learn = np.array([x & 1 for x in info], np.int64)
            words, code = np.unique(np.concatenate(parts), return_inverse=True)
            parts.clear()
            code = code.astype(np.int32)
            right = np.ones(len(code), bool)  # a text is the start, its words and its end
            right[np.concatenate([[0], np.cumsum(n + 1)[:-1]])] = False
            at = np.flatnonzero(right)
            key = code[at - 1] * np.int64(len(words)) + code[at]
            del code, right, at
            pairs, index = np.unique(key, return_inverse=True)
            del key
            c = np.bincount(index, np.repeat(learn, n), len(pairs)).astype(np.int64)
            u, w = pairs // len(words), pairs % len(words)
            bucket = (mix(mix(words)[u] + words[w]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            if texts:
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order), dtype=np.int32)
                return _record(arrow, [(unit, _z(number[index]), _z(n), _z(np.array(ids, np.int64)), _z(np.array(info, np.int64)))])
            rows = []
            for b, some in _parts(bucket):
                own, place = np.unique(np.concatenate([u[some], w[some]]), return_inverse=True)
                k = len(some)
                rows.append((b, unit, _delta(words[own]), _delta(place[:k].astype(np.int32)), _z(place[k:].astype(np.int32)), _z(c[some])))
            return _record(arrow, rows)

        for batch in batches:
            for id_, null, learn, some in slices(batch, 3):
                h, ends = word_hashes(some, fold=True)
                h = np.maximum(h >> SHORTER, np.uint64(2))
                for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                    parts.append(np.concatenate([[END], h[a:b], [END]]).astype(np.uint64))
                    sizes.append(b - a + 1)
                    ids.append(id_[i])
                    info.append(int(learn[i]) + 2 * int(null[i]))
                    held += b - a + 2
                    if held >= HELD:
                        yield flush()
                        parts, sizes, ids, info, held, units = [], [], [], [], 0, units + 1
        if held:
            yield flush()

    return docs.select("id", "null", "learn", "text").mapInArrow(run, kind)


def _record(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)


def _parts(key: np.ndarray):
    """(key, places) for each distinct key."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


_BUCKET = "bucket int, words binary, u binary, w binary, c binary, place binary, held binary, units binary, n1 bigint, n2 bigint"


def _bucket(table: pa.Table, arrow: pa.Schema) -> pa.Table:
    """A bucket: its words, distinct pairs (u, w: numbers of words), learned counts c, and which of its pairs each unit holds."""
    out = []
    n = table.num_rows
    if n:
        words_in = [_sum(table["words"][i].as_py(), np.uint64) for i in range(n)]
        words = np.unique(np.concatenate(words_in))
        key = []
        for i in range(n):
            to = np.searchsorted(words, words_in[i])
            key.append(to[_sum(table["u"][i].as_py(), np.int64)] << 32 | to[_u(table["w"][i].as_py())])
        held = np.array([len(k) for k in key])
        pairs, place = np.unique(np.concatenate(key), return_inverse=True)
        c = np.bincount(place, np.concatenate([_u(table["c"][i].as_py()) for i in range(n)]), len(pairs)).astype(np.int64)
        out.append((table["bucket"][0].as_py(), _delta(words), _delta(pairs >> 32), _z(pairs & 0xFFFFFFFF), _z(c), _z(place), _z(held), _z(np.array(table["unit"].to_pylist(), np.int64)), int((c == 1).sum()), int((c == 2).sum())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)


def _stored_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df stored in the shared folder, bucketed by key, so that later groupings by it need no exchange of it. Its catalog entry, ``_millrace_table``, is to be dropped once it has been read."""
    spark = df.sparkSession
    table = f"millrace_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/millrace/{table}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.table(table)
    out._millrace_path, out._millrace_table = hadoop, table
    return out


# ---------------------------------------------------------------- sweeps


@dataclass
class Scalars:
    """What the driver knows: N, V, the customers and tables of the parent, discounts."""

    tokens: int = 0
    words: int = 0
    customers: int = 0
    tables: int = 0
    discount: float = 0.5
    parent: float = 0.5


_SENT = "kind int, bucket int, grp int, words binary, cu binary, tu binary, tw binary, own binary"
_BACK = "bucket int, grp int, sweep int, cu binary, tu binary, cw binary, tw binary, tokens bigint, known bigint, customers bigint, tables bigint, n1 bigint, n2 bigint"


def _parent(cw: np.ndarray, tw: np.ndarray, s: Scalars) -> np.ndarray:
    """The parent's predictive probability of words with cw customers at tw tables."""
    unknown = (STRENGTH[1] + s.parent * s.tables) / (STRENGTH[1] + s.customers) / (s.words + 1)
    return np.maximum(cw - s.parent * tw, 0) / (STRENGTH[1] + s.customers) + unknown


class _Pairs:
    """A bucket's pairs, decoded, and what came back for its words."""

    def __init__(self, row: dict, groups: int):
        self.bucket = row["bucket"]
        self.words = _sum(row["words"], np.uint64)
        self.u, self.w = _sum(row["u"], np.int32), _u(row["w"], np.int32)
        self.c = _u(row["c"], np.int32)
        self.grp = (mix(self.words) % np.uint64(groups)).astype(np.int64)

    def back(self, rows: list[dict]) -> list[np.ndarray]:
        """cu, tu, cw, tw for each word, from one sweep's rows."""
        out = [np.zeros(len(self.words), np.int64) for _ in range(4)]
        by = {r["grp"]: r for r in rows}
        for g, at in _parts(self.grp):
            for x, name in zip(out, ("cu", "tu", "cw", "tw"), strict=True):
                x[at] = _u(by[g][name], np.int64)
        return out


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _sweep(state: DataFrame, back: DataFrame | None, tables: DataFrame | None, groups: int, s: Scalars, sweep: int) -> DataFrame:
    """Draw all buckets' tables (one each where nothing came back yet). Rows of kind 0: a bucket's tables; of kind 1: its sums by word."""
    kind = StructType.fromDDL(_SENT)
    arrow = to_arrow_schema(kind)
    discount = s.discount

    def step(state_rows: list[dict], others: list[dict]) -> pa.Table:
        out = []
        for row in state_rows:
            x = _Pairs(row, groups)
            t = np.minimum(x.c, 1).astype(np.int64)
            mine = [r for r in others if r["bucket"] == x.bucket]
            own_tables = np.zeros(len(x.words), np.int64)  # the parent's, of each word, in the sweep before
            if mine:
                cu, tu, cw, tw = x.back([r for r in mine if r["grp"] >= 0])
                before = next((_u(r["cu"], np.int32) for r in mine if r["grp"] < 0), None)
                own_tables = tw
                at = np.flatnonzero(x.c > 1)
                own = t[at] if before is None else before.astype(np.int64)
                rng = np.random.default_rng([sweep, x.bucket])
                rest = np.maximum(tu[x.u[at]] - own, 0)
                t[at] = draw_tables(x.c[at].astype(np.int64), rest, _parent(cw, tw, s)[x.w[at]], discount, STRENGTH[0], rng, log_stirling(discount))
            out.append((0, x.bucket, -1, None, _z(t[x.c > 1].astype(np.int32)), None, None, None))
            n = len(x.words)
            sums = [np.bincount(x.u, x.c, n), np.bincount(x.u, t, n), np.bincount(x.w, t, n), own_tables]
            for g, at in _parts(x.grp):
                out.append((1, x.bucket, g, _delta(x.words[at]), *(_z(y[at].astype(np.int64)) for y in sums)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    state = state.select("bucket", "words", "u", "w", "c")
    if back is None:
        return state.groupBy("bucket").applyInArrow(lambda t: step(_rows(t), []), kind)
    both = back.select("bucket", "grp", "cu", "tu", "cw", "tw").unionByName(tables.select("bucket", "grp", "cu", F.lit(None).cast("binary").alias("tu"), F.lit(None).cast("binary").alias("cw"), F.lit(None).cast("binary").alias("tw")))
    return state.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(lambda a, b: step(_rows(a), _rows(b)), kind)


def _answers(sent: DataFrame, s: Scalars, sweep: int) -> DataFrame:
    """Totals by word, with the parent's tables drawn, back to each bucket for its words; the group's sums are in one row of each group."""
    kind = StructType.fromDDL(_BACK)
    arrow = to_arrow_schema(kind)
    parent, tables, base = s.parent, s.tables, 1 / (s.words + 1)

    def step(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [_sum(r["words"], np.uint64) for r in rows]
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        cu, tu, cw = (np.bincount(place, np.concatenate([_u(r[c], np.int64) for r in rows]), len(words)).astype(np.int64) for c in ("cu", "tu", "tw"))
        own = np.zeros(len(words), np.int64)
        own[place] = np.concatenate([_u(r["own"], np.int64) for r in rows])  # every bucket was told the same
        rng = np.random.default_rng([sweep, rows[0]["grp"], 7])
        tw = np.minimum(cw, 1) if not tables else draw_tables(cw, np.maximum(tables - own, 0), np.full(len(cw), base), parent, STRENGTH[1], rng, log_stirling(parent))
        out, at = [], 0
        for i, (r, k) in enumerate(zip(rows, keys, strict=True)):
            here = place[at : at + len(k)]
            at += len(k)
            total = [int(cu.sum()), int((cu > 0).sum()), int(cw.sum()), int(tw.sum()), int((cw == 1).sum()), int((cw == 2).sum())] if i == 0 else [0] * 6
            out.append((r["bucket"], r["grp"], sweep, *(_z(y[here]) for y in (cu, tu, cw, tw)), *total))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    return sent.groupBy("grp").applyInArrow(step, kind)


def _discount(n1: int, n2: int) -> float:
    """The usual estimate of a discount from the numbers of things seen once and twice."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5


# ---------------------------------------------------------------- scores

_PART = "unit bigint, bucket int, score binary, count binary"


def predictive(c: np.ndarray, t: np.ndarray, cu: np.ndarray, tu: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """The probability of a word with c customers at t tables in a restaurant with cu customers at tu tables in all."""
    return (np.maximum(c - discount * t, 0) + (STRENGTH[0] + discount * tu) * parent) / (STRENGTH[0] + cu)


def _scores(state: DataFrame, back: DataFrame, groups: int, s: list[Scalars]) -> DataFrame:
    """For each bucket and unit: the log10 probabilities of the unit's pairs, averaged over sweeps, and the counts of their words."""
    kind = StructType.fromDDL(_PART)
    arrow = to_arrow_schema(kind)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        out, others = [], b.to_pylist()
        for row in a.to_pylist():
            x = _Pairs(row, groups)
            mine = [r for r in others if r["bucket"] == x.bucket]
            p = np.zeros(len(x.c))
            for sweep, at_sweep in enumerate(s):
                of = [r for r in mine if r["sweep"] == sweep]
                cu, tu, cw, tw = x.back([r for r in of if r["grp"] >= 0])
                t = np.minimum(x.c, 1).astype(np.int64)
                t[x.c > 1] = _u(next(r for r in of if r["grp"] < 0)["cu"], np.int32)
                p += predictive(x.c, t, cu[x.u], tu[x.u], _parent(cw, tw, at_sweep)[x.w], at_sweep.discount)
            logp = np.log10(p / len(s))
            count = cu[x.w]  # as often as a word is a context, it occurs
            place, at = _u(row["place"]), 0
            for unit, n in zip(_u(row["units"]).tolist(), _u(row["held"]).tolist(), strict=True):
                own = place[at : at + n]
                at += n
                out.append((unit, x.bucket, _floats(logp[own]), _z(count[own])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return state.select("bucket", "words", "u", "w", "c", "place", "held", "units").groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(step, kind)


_RESULT = "doc_id bigint, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _summed(units: DataFrame, parts: DataFrame, s: Scalars) -> DataFrame:
    """The texts' scores: what came back for a unit's pairs, summed over each text's."""
    kind = StructType.fromDDL(_RESULT)
    arrow = to_arrow_schema(kind)
    tokens, words = s.tokens, s.words

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for row in a.to_pylist():
            n, ids, info, pairs = _u(row["sizes"]), _u(row["ids"]), _u(row["info"]), _u(row["pairs"])
            order = np.argsort(b["bucket"].to_numpy())  # the unit's pairs are numbered by bucket
            if int(pairs.max()) >= sum(len(_u(x.as_py(), np.int32)) for x in b["count"]):
                raise RuntimeError("the second scan of the texts has given other units than the first")
            logp = np.concatenate([_of_floats(b["score"][int(i)].as_py()) for i in order])
            count = np.concatenate([_u(b["count"][int(i)].as_py()) for i in order])
            start = np.cumsum(n) - n
            score, base, known = (np.add.reduceat(x[pairs], start) for x in (logp, np.log10((count + 1) / (tokens + words + 1)), (count > 0).astype(np.int64)))
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, mask=(info & 2) > 0), pa.array((info & 1) > 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(score)], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    return units.groupBy("unit").cogroup(parts.groupBy("unit")).applyInArrow(step, kind)


def score(docs: DataFrame, learn, burn: int = BURN, keep: int = KEEP) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    learn: a boolean column that says which rows the model learns from.
    """
    spark = docs.sparkSession
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "pitman-docs")  # read twice, it must come in the same partitions
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(total // BUCKET_BYTES + 1)
    groups = buckets
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("id"), F.col("doc_id").isNull().alias("null"), F.coalesce(learn, F.lit(True)).alias("learn"), "text")
    arrow = to_arrow_schema(StructType.fromDDL(_BUCKET))
    state = _stored_by(_tokens(docs, buckets, False).groupBy("bucket").applyInArrow(lambda t: _bucket(t, arrow), _BUCKET), "bucket", buckets, "pairs")
    freed(spark)
    n1, n2 = state.agg(F.sum("n1"), F.sum("n2")).first()
    s = Scalars(discount=_discount(n1 or 0, n2 or 0))
    back = tables = before = None
    kept, past, kept_back = [], [], []
    for sweep in range(burn + keep + 1):
        sent = stored(_sweep(state, back, tables, groups, s, sweep), "pitman-sent")
        dropped(before)  # nothing reads it any more
        if sweep <= burn + 1:
            dropped(back)  # the sweep before isn't kept
        before = sent
        tables = sent.where("kind = 0").select("bucket", "grp", "cu")
        back = stored(_answers(sent.where("kind = 1"), s, sweep), "pitman-back")
        freed(spark)
        a, b, c, d, e, f = back.agg(*(F.sum(x) for x in ("tokens", "known", "customers", "tables", "n1", "n2"))).first()
        s = Scalars(a or 0, b or 0, c or 0, d or 0, s.discount, _discount(e or 0, f or 0) if sweep == 0 else s.parent)
        if sweep > burn:
            n = len(kept)
            kept.append(s)
            tables = stored(tables, "pitman-tables")  # without the sums that were sent
            kept_back += [back, tables]
            cols = ["bucket", "grp", "cu", "tu", "cw", "tw"]
            none = F.lit(None).cast("binary")
            past.append(back.select(*cols, F.lit(n).alias("sweep")).unionByName(tables.select("bucket", "grp", "cu", none.alias("tu"), none.alias("cw"), none.alias("tw"), F.lit(n).alias("sweep"))))
    dropped(before)
    both = past[0]
    for x in past[1:]:
        both = both.unionByName(x)
    parts = _scores(state, both, groups, kept)
    out = stored(_summed(_tokens(docs, buckets, True), parts, s), "pitman-scores")
    spark.sql(f"DROP TABLE IF EXISTS {state._millrace_table}")
    for x in (state, *kept_back):
        dropped(x)
    return out
