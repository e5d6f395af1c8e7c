"""Near-duplicate detection by fast similarity sketching.

A document's set holds the hashes of its distinct word shingles. The sketch has
T coordinates: in round i each element falls into one hashed bin, carrying the
round and a hash; a bin keeps its least value, and rounds go on until every bin
is filled, at the latest in rounds T to 2T, in which round T + j puts every
element into bin j. So every coordinate fills, and the share of equal coordinates
is concentrated around the Jaccard similarity (Dahlgaard, Knudsen, Thorup 2017).
Bands of coordinates propose candidates, sketches sift them, and full sets
confirm links exactly.

Documents with equal sets form a class; only classes take part in the search.
In a band's bucket, members are compared with a hub, not with each other; the hub
is the member that shares most, so that copies of one text meet that text in all
their buckets. Where that leaves members in different components, those outside
the bucket's largest one are compared with all members of other components: in
buckets up to SMALL members pair by pair; larger buckets are joined into clusters,
and the outsiders of a cluster meet its members block by block, within tasks of
bounded size that return links only. Both ways make the same links (SMALL steers
cost alone), so no link between components is lost, no bucket is capped, and a
bucket of true copies costs one pass.

A sketch travels as a byte a coordinate, packed into longs, and is sifted by
Spark where a pair is made. With 32 bands of four, a pair at similarity 0.8
shares no band with a chance of 5e-8; the sieve at 0.58 is six standard
deviations below 0.8.

Null and empty texts, and texts without words, have no set and are linked with
nothing: their component_id is their doc_id. Rows with one doc_id are one
document. A null doc_id takes the least doc_id of its component, if any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_slices, mix, ngram_hashes, stored, text_key, word_hashes
from millrace.llm.graph import components

T, ROWS = 128, 4
BANDS = T // ROWS
SIEVE = 0.58
#: Members of a bucket whose outsiders are compared pair by pair; shingles of a block otherwise.
SMALL, BLOCK = 64, 1_000_000
_U32 = np.uint64(0xFFFFFFFF)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of shingles; fewer words than size make one shingle."""
    h, ends = word_hashes(texts, fold=True)
    words = (h[a:b] for a, b in zip([0, *ends[:-1]], ends))
    return [np.unique(ngram_hashes(w, min(size, len(w)))) if len(w) else w for w in words]


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """The sketches (sets by t) of non-empty sets; a coordinate holds its round and a hash."""
    out = np.full((len(sets), t), _FULL)
    flat = out.reshape(-1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        if not len(element):
            break
        h = mix(element ^ mix(np.full(1, (i + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)))
        value = (np.uint64(i) << np.uint64(32)) | (h & _U32)
        bins = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + bins, value)
        open_ = (out == _FULL).any(1)
        keep = open_[owner]
        if not keep.all():
            owner, element = owner[keep], element[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hashes of the bands of each sketch, each band with a seed of its own."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(mix(np.arange(t // rows, dtype=np.uint64) + np.uint64(77)), parts.shape[:2])
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key.astype(np.int64)


_SKETCHED = "doc_id bigint, key struct<a:bigint,b:bigint>, n_shingles bigint, node binary, sketch array<bigint>, bands array<bigint>"


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """Per row: n_shingles, the 128-bit hash of its set (``node``; null if empty), its sketch and its bands."""

    def start():
        def step(ids, texts, keys):
            sets = shingle_sets(texts, size)
            some = [i for i, s in enumerate(sets) if len(s)]
            sketch = sketches([sets[i] for i in some])
            bands = band_keys(sketch)
            short = (mix(sketch) >> np.uint64(56)).astype(np.uint8).view(np.int64)
            node, small, keys_of = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for at, i in enumerate(some):
                node[i], small[i], keys_of[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), short[at], bands[at]
            return ids, keys, [len(s) for s in sets], node, small, keys_of

        return step

    return map_slices(docs, ["doc_id", "text", text_key("text").alias("key")], _SKETCHED, start)


def _alike(x: Column, y: Column) -> Column:
    """Whether two sketches agree in at least the share SIEVE of their coordinates: bytes of the longs' difference that are zero."""
    odd = F.lit(0)
    for i in range(T // 8):
        z = x[i].bitwiseXOR(y[i])
        for bits in (4, 2, 1):  # a byte's lowest bit becomes the sum of its bits
            z = z.bitwiseOR(F.shiftrightunsigned(z, bits))
        odd = odd + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return odd <= int((1 - SIEVE) * T)


def _confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= 80 * union (for a share of 80 in 100)."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("elements").alias(f"e{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    part, whole = share

    def start():
        def step(a, b, ea, eb):
            keep = []
            for i in range(len(a)):
                x, y = np.frombuffer(ea[i], np.uint64), np.frombuffer(eb[i], np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if whole * inter >= part * (len(x) + len(y) - inter):
                    keep.append(i)
            return [a[i] for i in keep], [b[i] for i in keep]

        return step

    return map_slices(both, ["a", "b", "ea", "eb"], "a binary, b binary", start, text=2)


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted classes, made again from the text of one document each."""
    texts = docs.select("doc_id", "text", text_key("text").alias("key"))
    held = texts.join(nodes, texts["doc_id"].eqNullSafe(nodes["holder.doc_id"]) & (texts["key"] == nodes["holder.key"])).select("node", "text").dropDuplicates(["node"])

    def start():
        return lambda nodes, texts: (nodes, [s.tobytes() for s in shingle_sets(texts, size)])

    return map_slices(held, ["node", "text"], "node binary, elements binary", start)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node, n) of buckets that hold several components, with their component and whether they are outside the bucket's largest."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "label")).alias("main")).where("parts > 1")
    return named.join(several.select("key", F.col("main.label").alias("main")), "key").withColumn("outside", F.col("label") != F.col("main")).drop("main")


def _small_pairs(opened: DataFrame) -> DataFrame:
    """Pairs of outsiders with members of other components in buckets of at most SMALL members, sifted."""
    some = opened.where(F.col("n") <= SMALL)
    out = some.where("outside").select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("sa"))
    met = out.join(some.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("sb")), "key").where((F.col("la") != F.col("lb")) & _alike(F.col("sa"), F.col("sb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compare(share: tuple[int, int], schema: pa.Schema):
    """Of a block of members and one of outsiders: one link of each outsider to each other component that it is linked with."""
    part, whole = share

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
        node, label, role = table["node"].to_pylist(), table["label"].to_pylist(), table["outsider"].to_pylist()
        members, outsiders = [i for i, r in enumerate(role) if not r], [i for i, r in enumerate(role) if r]
        a, b = [], []
        if members and outsiders:
            sketch = np.array(table["sketch"].to_pylist(), np.int64).view(np.uint8)
            of_members = sketch[members]
            size = np.array([len(sets[i]) for i in members])
            codes = {x: i for i, x in enumerate(dict.fromkeys(label))}
            of = np.array([codes[label[i]] for i in members])
            for i in outsiders:
                s = sets[i]
                linked = set()
                for at in np.flatnonzero(((of_members == sketch[i]).mean(1) >= SIEVE) & (of != codes[label[i]])):
                    if of[at] in linked or whole * min(size[at], len(s)) < part * max(size[at], len(s)):
                        continue
                    inter = len(np.intersect1d(s, sets[members[at]], assume_unique=True))
                    if whole * inter >= part * (size[at] + len(s) - inter):
                        linked.add(of[at])
                        a.append(node[i])
                        b.append(node[members[at]])
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def _block_links(opened: DataFrame, classes: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between components in buckets of more than SMALL members.

    Buckets that share members make a cluster. Its outsiders, all outside its
    largest component, and its members are dealt into blocks; each pair of
    blocks is a task. Data sent grow with members times blocks of outsiders.
    """
    large = opened.where(F.col("n") > SMALL)
    edges = large.join(large.groupBy("key").agg(F.min("node").alias("a")), "key").select("a", F.col("node").alias("b"))
    clusters = components(edges).select("node", F.col("label").alias("cluster"))
    placed = stored(large.select("node", "label").distinct().join(clusters, "node").join(classes.select("node", "n_shingles"), "node"), "near-clusters")
    sizes = placed.groupBy("cluster", "label").agg(F.sum("n_shingles").alias("c"))
    whole = sizes.groupBy("cluster").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("main"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    whole = whole.select("cluster", F.col("main.label").alias("main"), blocks(F.col("all")).alias("mb"), blocks(F.col("all") - F.col("main.c")).alias("ob")).where("ob > 0")
    placed = placed.join(whole, "cluster")
    of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = placed.select("cluster", "node", "label", of(F.col("mb")).alias("m"), each(F.col("ob")).alias("o"), F.lit(False).alias("outsider"))
    outsiders = placed.where(F.col("label") != F.col("main")).select("cluster", "node", "label", each(F.col("mb")).alias("m"), of(F.col("ob")).alias("o"), F.lit(True).alias("outsider"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    return members.unionByName(outsiders).join(classes.select("node", "sketch"), "node").join(sets, "node").groupBy("cluster", "m", "o").applyInArrow(_compare(share, schema), "a binary, b binary")


def _with_hub(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members (key, node, n) of buckets with their sketch, whether they are their bucket's hub, and the hub, which is null where the sieve tells them apart.

    The hub is the member whose buckets are largest in all. What others were
    copied from shares most of its bands, so its copies meet it in all their
    buckets: one pair each, not one for each of many hubs.
    """
    own = members.groupBy("node").agg(F.sum("n").alias("weight")).join(classes.select("node", "sketch"), "node")
    members = members.join(own, "node")
    hubs = members.groupBy("key").agg(F.max(F.struct("weight", "node", "sketch")).alias("hub"))
    is_hub = F.col("node") == F.col("hub.node")
    near = ~is_hub & _alike(F.col("sketch"), F.col("hub.sketch"))
    return members.join(hubs, "key").select("key", "node", "n", "sketch", is_hub.alias("is_hub"), F.when(near, F.col("hub.node")).alias("hub"))


def links(docs: DataFrame, sketched_docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """node, label: the components of the classes that have a link."""
    some = sketched_docs.where("node is not null")
    of_class = [F.min_by(F.struct("doc_id", "key"), F.struct("doc_id", "key")).alias("holder"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")]
    classes = stored(some.groupBy("node").agg(*of_class), "near-classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(_with_hub(stored(banded.join(shared, "key"), "near-shared"), classes), "near-members")
    sets = stored(_sets(docs, members.select("node").distinct().join(classes.select("node", "holder"), "node"), size), "near-sets")
    # Rows with one doc_id are one document, so their classes are linked.
    ids = some.where("doc_id is not null").select("doc_id", "node").distinct()
    same = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = ids.join(same, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    pairs = stored(members.where("hub is not null").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    found = stored(_confirm(pairs, sets, share).union(same), "near-links")
    labels = components(found)
    opened = stored(_open(members.where("n > 2 and not is_hub").select("key", "node", "n", "sketch"), labels), "near-open")
    if opened.isEmpty():
        return labels
    few = _confirm(stored(_small_pairs(opened), "near-pairs"), sets, share)
    return components(found.union(few).union(_block_links(opened, classes, sets, share)))


def _labelled(docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, key, n_shingles, node, and the node's label and component_id, for every row of docs; node is null where there is no set."""
    sk = stored(sketched(docs, size), "near-sketches")
    labels = links(docs, sk, size, share)
    named = sk.groupBy("node").agg(F.min("doc_id").alias("least")).where("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "near-named")
    low = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(low, "label").select(F.col("node").alias("n"), "label", "component_id")
    return sk.select("doc_id", "key", "n_shingles", "node").join(of, F.col("node") == F.col("n"), "left")


def group(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id and kept, for every row of docs.

    component_id is the least doc_id reachable by links, kept whether it is the
    document's own.
    """
    out = _labelled(docs.select("doc_id", "text"), size, share)
    component: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each group, with docs' columns: that of the least doc_id (null is the last), then key; and all rows without a set."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with ours
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = _labelled(docs.select("doc_id", "text"), size, share)
    least = rows.where("node is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("least"))
    loose = rows.where("node is null").select("doc_id", F.col("key").alias("k"), F.lit(False).alias("one")).distinct()
    kept = least.select("least.doc_id", F.col("least.key").alias("k"), F.lit(True).alias("one")).union(loose)
    mine = docs.toDF(*names).withColumn("key", text_key(text))
    both = mine.join(kept, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("k")))
    others = F.to_json(F.struct(F.lit(0), *(c for c in names if c not in (doc_id, text))))
    nth = F.row_number().over(Window.partitionBy(doc_id, "key").orderBy(others))
    return both.withColumn("nth", nth).where("nth = 1 or not one").select(*names).toDF(*docs.columns)
