"""Line dedup by runs of lines, or by content-defined chunks of lines.

With ``runs``, as the queries call it, any two neighbouring lines whose bytes
occur earlier, in any surroundings, are repeated; repeated pairs merge to maximal
runs, and a run of LEAST_BYTES or more is removed. Within one text the two
places mustn't overlap. The first occurrence of every line stays.

Without ``runs``, whole chunks only are compared, so repeats that hold no whole
chunk stay:


A text is cut into lines at ``\\n``. A rolling hash over the hashes of
consecutive lines chooses chunk boundaries, so that boundaries move with the
content when lines are inserted or removed before them. A chunk of two lines or
more whose bytes occur earlier (in a document with a smaller doc_id, or earlier
in the same one) is removed, after its bytes have been compared with those of
the first occurrence; the lines left are joined again by ``\\n``.

Null texts stay null, empty texts empty; a null doc_id counts as later than any
other. Among rows with one doc_id the hash of the text decides which is first;
equal rows count as one, so both keep their first occurrence. Other columns are
carried along unread.
"""

from __future__ import annotations


import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import map_slices, mix, stored, text_key

#: A boundary falls after one in so many lines; chunks have at least so many lines and bytes.
SPACING, LEAST_LINES, LEAST_BYTES = 3, 2, 40
#: Lines that a boundary's hash covers, and the most lines of a chunk.
SPAN, MOST_LINES = 2, 64
_LAST = (1 << 63) - 1


def chunks(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first line, end line, bytes) of the chunks of a text, of all lengths."""
    if text is None:
        return []
    lines = text.encode("utf-8").split(b"\n")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolled = h.copy()
    for i in range(1, SPAN):
        rolled[i:] = mix(rolled[i:] + h[:-i])
    cut = mix(rolled) % np.uint64(SPACING) == 0
    out, first = [], 0
    for i in range(len(lines)):
        n = i + 1 - first
        if n >= LEAST_LINES and cut[i] or n >= MOST_LINES or i + 1 == len(lines):
            out.append((first, i + 1, b"\n".join(lines[first : i + 1])))
            first = i + 1
    return out


def _eligible(first: int, end: int, raw: bytes) -> bool:
    return end - first >= LEAST_LINES and len(raw.strip()) >= LEAST_BYTES


_CHUNKS = "id bigint, key struct<a:bigint,b:bigint>, number int, h struct<a:bigint,b:bigint>"


def _listed(docs: DataFrame) -> DataFrame:
    """A row for each eligible chunk: its document, number and 128-bit hash."""

    def start():
        def step(ids, texts, keys):
            rows = ([], [], [], [])
            for d, t, k in zip(ids, texts, keys, strict=True):
                for number, (a, b, raw) in enumerate(chunks(t)):
                    if _eligible(a, b, raw):
                        h = xxhash.xxh3_128_digest(raw)
                        for out, x in zip(rows, (d, k, number, {"a": int.from_bytes(h[:8], "big", signed=True), "b": int.from_bytes(h[8:], "big", signed=True)}), strict=True):
                            out.append(x)
            return rows

        return step

    return map_slices(docs, [F.coalesce("doc_id", F.lit(_LAST)).cast("bigint").alias("id"), "text", text_key("text").alias("key")], _CHUNKS, start)


def repeats(docs: DataFrame) -> DataFrame:
    """The chunks to remove, after comparing bytes: id, key (of the row's text), numbers (array of chunk numbers).

    Chunks are first matched by hash; the first occurrence of each repeated hash
    hands its bytes to the others, whose own bytes are compared where the text
    is (:func:`dedup`); here only those bytes travel.
    """
    listed = stored(_listed(docs).distinct(), "lines-chunks")
    first = listed.groupBy("h").agg(F.min(F.struct("id", "key", "number")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    first = stored(first, "lines-first")
    holders = first.groupBy("first.id", "first.key").agg(F.collect_list(F.struct("first.number", "h")).alias("wanted"))
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("bigint").alias("id"), "text", text_key("text").alias("key"))
    held = texts.join(holders, ["id", "key"]).dropDuplicates(["id", "key"])

    def start():
        def step(texts, wanted):
            hashes, raws = [], []
            for t, w in zip(texts, wanted, strict=True):
                parts = chunks(t)
                for x in w:
                    hashes.append(x["h"])
                    raws.append(parts[x["number"]][2])
            return hashes, raws

        return step

    raw = map_slices(held, ["text", "wanted"], "h struct<a:bigint,b:bigint>, raw binary", start, text=0)
    later = listed.join(first, "h").where(F.struct("id", "key", "number") != F.col("first")).select("h", "id", "key", "number")
    return later.join(raw, "h").select("id", "key", F.struct("number", "raw").alias("repeat"))


_RUNS = "id bigint, key struct<a:bigint,b:bigint>, at int, n int, first struct<id:bigint,key:struct<a:bigint,b:bigint>,number:int>"


def _pairs(docs: DataFrame) -> DataFrame:
    """A row for each LEAST_LINES neighbouring lines: their document, first line's number and 128-bit hash."""

    def start():
        def step(ids, texts, keys):
            rows = ([], [], [], [])
            for d, t, k in zip(ids, texts, keys, strict=True):
                lines = (t or "").encode("utf-8").split(b"\n")
                for number in range(len(lines) - LEAST_LINES + 1):
                    h = xxhash.xxh3_128_digest(b"\n".join(lines[number : number + LEAST_LINES]))
                    for out, x in zip(rows, (d, k, number, {"a": int.from_bytes(h[:8], "big", signed=True), "b": int.from_bytes(h[8:], "big", signed=True)}), strict=True):
                        out.append(x)
            return rows

        return step

    return map_slices(docs, [F.coalesce("doc_id", F.lit(_LAST)).cast("bigint").alias("id"), "text", text_key("text").alias("key")], _CHUNKS, start)


def _joined_up(later: DataFrame) -> DataFrame:
    """Repeated pairs that follow each other, as their first occurrences do, as one run: its row, first line, number of lines and first occurrence."""

    def start():
        def step(ids, keys, pairs):
            rows = ([], [], [], [], [])
            for d, k, found in zip(ids, keys, pairs, strict=True):
                runs = []
                for number, i, a, b, f in sorted({(x["number"], x["first"]["id"], x["first"]["key"]["a"], x["first"]["key"]["b"], x["first"]["number"]) for x in found}):
                    if runs and runs[-1][:3] == [i, a, b] and runs[-1][3] - runs[-1][4] == f - number and number == runs[-1][4] + runs[-1][5] - LEAST_LINES + 1:
                        runs[-1][5] += 1
                    else:
                        runs.append([i, a, b, f, number, LEAST_LINES])
                for i, a, b, f, number, n in runs:
                    for out, x in zip(rows, (d, k, number, n, {"id": i, "key": {"a": a, "b": b}, "number": f}), strict=True):
                        out.append(x)
            return rows

        return step

    grouped = later.groupBy("id", "key").agg(F.collect_list(F.struct("number", "first")).alias("pairs"))
    return map_slices(grouped, ["id", "key", "pairs"], _RUNS, start, text=None)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The runs of lines that occur earlier: id, key (of the row's text), repeat (at: its first line, n: its lines, raw: the first occurrence's bytes as zstd, to compare)."""
    place = F.struct("id", "key", "number")
    listed = stored(_pairs(docs), "lines-pairs")
    # Summed by task before the shuffle; a join, unlike a window, can be split where one hash has very many rows.
    first = listed.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    listed = listed.join(first, "h")
    same_row = (F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key"))
    later = listed.where(~same_row | (F.col("number") >= F.col("first.number") + LEAST_LINES)).select("id", "key", "number", "first")
    runs = stored(_joined_up(later), "lines-runs")
    wanted = runs.select("first", "n").distinct().groupBy(F.col("first.id").alias("id"), F.col("first.key").alias("key")).agg(F.collect_list(F.struct("first.number", "n")).alias("wanted"))

    def packing():
        pack = zstandard.ZstdCompressor(level=1)
        return lambda ids, texts, keys: (ids, keys, [pack.compress((t or "").encode("utf-8")) for t in texts])

    packed = map_slices(docs, [F.coalesce("doc_id", F.lit(_LAST)).cast("bigint").alias("id"), "text", text_key("text").alias("key")], "id bigint, key struct<a:bigint,b:bigint>, z binary", packing)
    held = packed.join(wanted, ["id", "key"]).dropDuplicates(["id", "key"])

    def start():
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def step(ids, keys, texts, wanted):
            firsts, sizes, raws = [], [], []
            for d, k, z, w in zip(ids, keys, texts, wanted, strict=True):
                lines = unpack.decompress(z).split(b"\n")
                for x in w:
                    firsts.append({"id": d, "key": k, "number": x["number"]})
                    sizes.append(x["n"])
                    raws.append(pack.compress(b"\n".join(lines[x["number"] : x["number"] + x["n"]])))
            return firsts, sizes, raws

        return step

    raw = map_slices(held, ["id", "key", "z", "wanted"], "first struct<id:bigint,key:struct<a:bigint,b:bigint>,number:int>, n int, raw binary", start, text=2)
    return runs.join(raw, ["first", "n"]).select("id", "key", F.struct("at", "n", "raw").alias("repeat"))


def without(text: str, repeats: list, unpack) -> tuple[str, int]:
    """The text without its repeated runs, whose bytes are compared, and the number of lines removed. Runs that touch are one; it has LEAST_BYTES or stays."""
    lines = text.encode("utf-8").split(b"\n")
    gone = np.zeros(len(lines), bool)
    for x in repeats:
        if b"\n".join(lines[x["at"] : x["at"] + x["n"]]) == unpack.decompress(x["raw"]):  # the byte comparison
            gone[x["at"] : x["at"] + x["n"]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2).tolist():
        if len(b"\n".join(lines[a:b]).strip()) < LEAST_BYTES:
            gone[a:b] = False
    return b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g).decode("utf-8"), int(gone.sum())


def dedup(docs: DataFrame, counts: bool = False, runs: bool = False) -> DataFrame:
    """docs with repeated chunks, or runs of lines, removed from ``text``; with counts, n_lines and n_removed (long) follow its own columns."""
    found = (repeated_runs(docs) if runs else repeats(docs)).groupBy("id", "key").agg(F.collect_list("repeat").alias("repeats"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column's name clashes with ours
    at = docs.columns.index("text")
    mine = docs.toDF(*names).select("*", F.coalesce(f"c{docs.columns.index('doc_id')}", F.lit(_LAST)).cast("bigint").alias("id"), text_key(f"c{at}").alias("key"))
    both = mine.join(found, ["id", "key"], "left").drop("id", "key")
    kind = StructType.fromDDL("n_lines bigint, n_removed bigint")
    schema = StructType([*(f for f in docs.toDF(*names).schema), *kind])

    def start():
        unpack = zstandard.ZstdDecompressor()

        def step(*columns):
            *columns, repeated = columns
            texts, lines, removed = [], [], []
            for t, r in zip(columns[at], repeated, strict=True):
                n = 0 if t is None else t.count("\n") + 1
                lines.append(n)
                if not r:
                    texts.append(t)
                    removed.append(0)
                    continue
                if runs:
                    t, n = without(t, r, unpack)
                    texts.append(t)
                    removed.append(n)
                    continue
                raws = {x["number"]: x["raw"] for x in r}
                parts = chunks(t)
                kept = [raw for i, (_, _, raw) in enumerate(parts) if raws.get(i) != raw]  # the byte comparison
                texts.append(b"\n".join(kept).decode("utf-8"))
                removed.append(sum(b - a for i, (a, b, raw) in enumerate(parts) if raws.get(i) == raw))
            columns[at] = texts
            return *columns, lines, removed

        return step

    out = map_slices(both, [*names, "repeats"], schema, start, text=at)
    return out.toDF(*docs.columns, "n_lines", "n_removed") if counts else out.select(*names).toDF(*docs.columns)


def report(docs: DataFrame, runs: bool = False) -> DataFrame:
    """The digest of :func:`dedup`: doc_id, n_lines, n_removed, kept_sha256."""
    out = dedup(docs.select("doc_id", "text"), counts=True, runs=runs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


__all__ = ["chunks", "dedup", "repeated_runs", "repeats", "report"]
