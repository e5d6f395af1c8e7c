"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are its pairs of neighbouring words (the last word pairs with
the end), each with its occurrence number, so a repeated pair counts as often as
it occurs. The hash of (k-mer, occurrence) deals them into BINS bins; each bin
keeps its TUPLE least ones, puts them back in text order and hashes the tuple.
Two texts agree in a bin if the same k-mers are least there and stand in the
same order, so the likeness falls with edit distance, not only with lost words.

The edited text needs the next document by descending doc_id. Documents are
dealt by ranges of doc_id, whose bounds are approximate quantiles (at most
MOST_RANGES, so a bounded list), and a window within each range finds the next;
only the first document of each range crosses over to another range. Texts are
shuffled once.

Null texts count as empty; the empty text has one k-mer, the empty word. Null
doc_ids come after all others; among equal doc_ids the hash of the text decides.
A single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins (a power of two: 2**BIN_BITS) and k-mers kept in each.
BIN_BITS, TUPLE = 6, 2
#: Bits of a packed k-mer that hold its place in the text.
PLACE = 24
#: Documents meant for a range, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16
_PLACE_MASK = (1 << PLACE) - 1
# Scripts written without spaces: each character is a word.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}])"


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with ``name``: the fingerprint of ``text`` as an array of (bin, tuple hash) packed into longs, in order of the bins."""
    spaced = F.when(F.col(text).rlike(_UNSPACED), F.regexp_replace(text, _UNSPACED, "$1 ")).otherwise(F.col(text))
    df = df.withColumn("_words", F.split(F.translate(spaced, "\n\t\r", "   "), " "))
    # k-mer hash in the high bits, place in the low ones: sorted, equal k-mers stand together in text order.
    packed = F.transform("_words", lambda w, i: F.shiftleft(F.shiftright(F.xxhash64(w, F.get(F.col("_words"), i + 1)), PLACE), PLACE).bitwiseOR(i.bitwiseAND(F.lit(_PLACE_MASK)).cast("bigint")))
    df = df.withColumn("_kmers", F.sort_array(packed)).drop("_words")
    starts = F.filter(F.sequence(F.lit(0), F.size("_kmers") - 1), lambda i: (i == 0) | (F.shiftright(F.get(F.col("_kmers"), i), PLACE) != F.shiftright(F.get(F.col("_kmers"), i - 1), PLACE)))
    df = df.withColumn("_starts", starts)
    # A run of equal k-mers gets the occurrence numbers 0, 1, ...; without runs all are 0.
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_starts") - 1), lambda j: F.sequence(F.lit(0), F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_kmers")) - F.get(F.col("_starts"), j) - 1)))
    df = df.withColumn("_occurrence", F.when(F.size("_starts") == F.size("_kmers"), F.array_repeat(F.lit(0), F.size("_kmers"))).otherwise(runs)).drop("_starts")
    dealt = F.zip_with("_kmers", "_occurrence", lambda k, o: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(k, PLACE), o), PLACE), PLACE).bitwiseOR(k.bitwiseAND(F.lit(_PLACE_MASK))))
    df = df.withColumn("_dealt", F.sort_array(dealt)).drop("_kmers", "_occurrence")
    least = F.filter("_dealt", lambda x, i: (i < TUPLE) | (_bin(F.get(F.col("_dealt"), i - TUPLE)) != _bin(x)))
    df = df.withColumn("_least", least).drop("_dealt")
    place = lambda x: x.bitwiseAND(F.lit(_PLACE_MASK))
    kmer = lambda x: F.shiftrightunsigned(x, PLACE)

    def ordered(x: Column, i: Column) -> Column:
        y = F.get(F.col("_least"), i + 1)
        same = _bin(y) == _bin(x)
        both = F.when(place(x) < place(y), F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        tuple_ = F.when(same, both).otherwise(F.xxhash64(kmer(x)))
        value = F.shiftleft(_bin(x), 34).bitwiseOR(F.shiftrightunsigned(tuple_, 30))
        return F.when((i == 0) | (_bin(F.get(F.col("_least"), i - 1)) != _bin(x)), value)

    return df.withColumn(name, F.filter(F.transform("_least", ordered), lambda v: v.isNotNull())).drop("_least")


def likeness(a: str, b: str) -> Column:
    """The share of bins, among those filled in either, in which the tuples agree."""
    bins = lambda c: F.transform(c, lambda v: F.shiftrightunsigned(v, 34))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def shown(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.hex(v))), ".")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below doc_id, sought in two steps; -1 for null."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731 (folded to one constant)
    coarse = F.size(F.filter(longs(bounds[::step]), lambda b: b < doc_id))
    fine = F.size(F.filter(F.slice(longs(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b < doc_id))
    return F.when(doc_id.isNull(), -1).otherwise(F.greatest(coarse - 1, F.lit(0)) * step + fine)


def with_next(docs: DataFrame, text: str, fingerprint: str) -> DataFrame:
    """docs (doc_id, h: hash of the text, text) with the fingerprint of the text, and ``next``: a struct of the text and fingerprint of the next document by descending doc_id."""
    n = docs.agg(F.count("*")).first()[0]
    ranges = min(MOST_RANGES, n // RANGE_ROWS + 1)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] or [])) if shares else []
    docs = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    within = Window.partitionBy("range").orderBy(*order)
    # The first document of each range: at most MOST_RANGES + 1 rows of numbers on the driver.
    tops = docs.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("top")).select("range", "top.doc_id", "top.h").collect()
    down = sorted(tops, key=lambda r: -r[0])
    after = [(a[0], b[1], b[2]) for a, b in zip(down, down[1:] + down[:1])]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(after, "before int, top_id bigint, top_h bigint"))
    first = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("top_id")) & (docs["h"] == F.col("top_h")))
    first = with_fingerprint(first.groupBy(F.col("before").alias("range")).agg(F.first(text).alias(text)), text, fingerprint)
    first = first.select("range", F.struct(text, fingerprint).alias("top"))
    out = with_fingerprint(docs, text, fingerprint).withColumn("next", F.lead(F.struct(text, fingerprint)).over(within))
    # Joined on the range alone, for which the rows are in place already; only each range's last row takes what it finds.
    return out.join(first, "range", "left").withColumn("next", F.coalesce("next", "top")).drop("top", "range")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = with_next(docs.withColumn("h", F.xxhash64("text")), "text", "f")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    out = out.select("doc_id", n.cast("bigint").alias("n_chars"), "f", F.col("next.f").alias("fn"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"))
    out = with_fingerprint(out, "edited", "fe")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("f").alias("fingerprint"), shown("fe").alias("edited_fingerprint"),
        likeness("f", "fe").alias("near_edited"), likeness("f", "fn").alias("near_next"),
    )
