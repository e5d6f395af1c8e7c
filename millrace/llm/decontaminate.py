"""Benchmark decontamination by one Aho-Corasick automaton over item windows.

Texts and items are normalised alike: A-Z lowered, words of ASCII digits,
letters and all non-ASCII characters, one space between words. A window is
``window`` consecutive words of an item (a shorter, non-empty item is one
window). Each text is scanned once; hits are mapped back to word numbers and to
offsets in the original text.

The items are dealt by hash to blocks of about ``BLOCK_WORDS`` words, so that an
automaton's size is bounded however large the benchmark is; an item goes to one
block whole. The driver holds one block at a time, to broadcast it. With more
than one block, each scans the texts once, its hits are stored, and the hits of a
text in all blocks are merged by its key. Null and empty texts have no words and
no hits; items without words have no windows; an item_id that several items share
is reported once. An item with a null item_id hits words, but isn't listed.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_slices, stored, text_key

WINDOW = 10
#: Words of items in one automaton; about a GB of nodes a million words.
BLOCK_WORDS = 200_000
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def norm_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


class Windows:
    """The automaton of the windows of (item_id, text) pairs."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        owners: dict[str, tuple[int, set]] = {}
        for item_id, text in items:
            words = norm_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                key = b" ".join([b"", *part, b""]).decode("latin-1")
                owners.setdefault(key, (len(part), set()))[1].add(item_id)
        self.machine = ahocorasick.Automaton()
        for key, value in owners.items():
            self.machine.add_word(key, value)
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """The number of words, the merged hit word ranges and the items found."""
        words = norm_words(text)
        if not words or self.empty:
            return len(words), [], set()
        joined = b" ".join([b"", *words, b""])
        ranges, items, ends = [], set(), None
        for end, (n, owned) in self.machine.iter(joined.decode("latin-1")):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            last = int(np.searchsorted(ends, end))
            ranges.append((last - n, last))
            items |= owned
        return len(words), merge(ranges), items

    @staticmethod
    def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Word ranges as code-point offsets of the original text."""
        at = [m.span() for m in _WORD.finditer(text)] if ranges else []
        return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """item_id, text and block of the items, and the number of blocks. Runs of blanks and signs are counted as words' ends, so words are rather over-counted."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-n // block_words))
    return items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))), blocks


_HITS = "doc_id bigint, n_words bigint, ranges array<struct<a:int,b:int>>, spans array<struct<start:int,end:int>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, hit word ``ranges``, ``spans`` (code points of the original text), ``items`` (ids as sorted strings), and the columns named in ``keep``."""
    items, blocks = blocks_of(benchmark, block_words)
    sc = docs.sparkSession.sparkContext

    def scanned(block: int, extra: list, names: str):
        shipped = sc.broadcast([(r[0], r[1]) for r in items.where(F.col("block") == block).select("item_id", "text").collect()])

        def start():
            machine = Windows(shipped.value, window)

            def step(ids, texts, *rest):
                n, ranges, spans, items = [], [], [], []
                for t in texts:
                    k, r, found = machine.scan(t)
                    n.append(k)
                    ranges.append([{"a": a, "b": b} for a, b in r])
                    spans.append([{"start": a, "end": b} for a, b in machine.offsets(t, r)])
                    items.append(sorted(str(x) for x in found if x is not None))
                return ids, n, ranges, spans, items, *rest

            return step

        return map_slices(docs, ["doc_id", "text", *extra], _HITS + names, start)

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if blocks == 1:
        return scanned(0, list(keep), kinds)
    docs = docs.select("doc_id", "text", *keep, text_key("text").alias("key"))
    key = ", key struct<a:bigint,b:bigint>"
    found = None  # the hits in all blocks, of the row that they belong to; equal rows have equal hits
    for block in range(1, blocks):
        hits = stored(scanned(block, ["key"], key).where(F.size("ranges") > 0).withColumn("block", F.lit(block)), "decontaminate-hits")
        found = hits if found is None else found.unionByName(hits)
    found = found.dropDuplicates(["doc_id", "key", "block"]).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.flatten(F.collect_list("ranges")).alias("r2"), F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"))
    first = scanned(0, ["key", *keep], key + kinds)
    out = first.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "n_words", _merged("ranges", "r2", "a", "b").alias("ranges"), _merged("spans", "s2", "start", "end").alias("spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.array().cast("array<string>"))))).alias("items"), *keep)


def _merged(first: str, second: str, a: str, b: str):
    """The union of two arrays of ranges, sorted and merged."""
    kind = f"array<struct<{a}:int,{b}:int>>"
    both = f"array_sort(concat({first}, coalesce({second}, cast(array() as {kind}))))"
    return F.expr(
        f"aggregate({both}, cast(array() as {kind}), (out, x) -> case when size(out) > 0 and x.{a} <= element_at(out, -1).{b}"
        f" then concat(slice(out, 1, size(out) - 1), array(named_struct('{a}', element_at(out, -1).{a}, '{b}', greatest(element_at(out, -1).{b}, x.{b}))))"
        f" else concat(out, array(x)) end)"
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The digest of :func:`find`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find(docs, benchmark, window, block_words)
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + (r["b"] - r["a"]))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))



def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, with docs' columns; null and empty texts, null doc_ids and repeated rows stay like any other."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with ours
    mine = docs.toDF(*names).select("*", *(F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text")))
    hits = find(mine, benchmark, window, block_words, keep=tuple(names))
    return hits.where(F.size("ranges") == 0).select(*names).toDF(*docs.columns)
