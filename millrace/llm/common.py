"""What the training-data operators share: tokens, hashes, Arrow mapping, tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A slice of a batch handed to an operator: at most so many rows or characters.
SLICE_ROWS, SLICE_CHARS = 1024, 2 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8 bytes."""
    return text.encode("utf-8").lower().split() if text else []


def raw_words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged, as UTF-8 bytes."""
    return text.encode("utf-8").split() if text else []


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least n of each; they depend on nothing else."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        tables = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for t in tables:
            t[0] = 1
        _powers[:] = [np.multiply.accumulate(t) for t in tables]
    return _powers


#: Bytes of a word that the rolling polynomial reads (longer words are hashed whole, one by one), and bytes hashed at once.
_LONG, _PIECE = 32, 1 << 20
_byte_values = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_folded_values = _byte_values.copy()
_folded_values[65:91] = _byte_values[97:123]


def word_hashes(texts: list[str | bytes | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all the texts, one after another, and the number of words up to each text's end; fold: as if A-Z were lowered."""
    raw = [t.encode("utf-8") if isinstance(t, str) else t or b"" for t in texts]
    joined = b" ".join(raw)
    buf = np.frombuffer(joined, np.uint8)
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = (buf == 32) | (buf - np.uint8(9) <= 4)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    stop, values, out = np.minimum(end, start + _LONG), _folded_values if fold else _byte_values, np.empty(len(start), np.uint64)
    cuts = np.flatnonzero(np.diff(start // _PIECE, prepend=-1, append=-1)).tolist() if len(start) else []
    for lo, hi in zip(cuts, cuts[1:]):
        first, last = int(start[lo]), int(stop[hi - 1])
        up, down = _power_tables(last - first + 1)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values[buf[first:last]] * up[: last - first], out=total[1:])
        a, b = start[lo:hi] - first, stop[lo:hi] - first
        out[lo:hi] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG).tolist():
        word = joined[start[i] : end[i]]
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
    return out, np.searchsorted(start, np.cumsum([len(x) + 1 for x in raw]) - 1)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive elements of h (hashes themselves); empty if there are fewer. A rolling polynomial modulo 2**64, mixed."""
    if len(h) < n:
        return h[:0]
    up, down = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def slices(batch: pa.RecordBatch, text: int | None) -> Iterator[list[list]]:
    """The batch's columns as Python lists, a bounded piece at a time."""
    n, at = batch.num_rows, 0
    sizes = None
    if text is not None and n:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    while at < n:
        to = min(n, at + SLICE_ROWS)
        if sizes is not None:
            low = sizes[at - 1] if at else 0
            to = min(to, max(at + 1, int(np.searchsorted(sizes, low + SLICE_CHARS, "right"))))
        part = batch.slice(at, to - at)
        yield [c.to_pylist() for c in part.columns]
        at = to


def shipped(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once a context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._millrace_shipped = True


def map_slices(df: DataFrame, columns: list[str | Column], schema: str | StructType, start: Callable, text: int | None = 1) -> DataFrame:
    """Map df's columns by ``start()(lists) -> lists of output columns``.

    ``start`` runs once a task, so that what it builds serves all the task's
    rows. ``text`` is the index of the column whose length bounds a slice.
    Partitions may be empty; the output columns may be lists or Arrow arrays.
    """
    shipped(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        step = None
        for batch in batches:
            for lists in slices(batch, text):
                step = step or start()
                out = step(*lists)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, kind)


_INTS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8")]


def pack_ints(x: np.ndarray) -> bytes:
    """Integers as bytes: the narrowest type that holds them, byte planes apart, zstd."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    code = 4 if low < 0 else next(i for i in range(4) if high < 1 << 8 * _INTS[i].itemsize)
    kind = _INTS[code]
    planes = np.ascontiguousarray(x.astype(kind, copy=False)).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([code]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(raw: bytes, kind=np.int64) -> np.ndarray:
    of = _INTS[raw[0]]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(of.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(of).reshape(-1).astype(kind, copy=False)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, where it is unset and Spark runs in one machine (as in tests), a local one of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(spark, "_millrace_dir", None):
        spark._millrace_dir = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return spark._millrace_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    This cuts the lineage: an executor lost later costs no recomputation of what
    is stored. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = hadoop
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete what :func:`stored` has written, once nothing reads it any more."""
    if df is not None and (path := getattr(df, "_millrace_path", None)) is not None:
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what has been stored meanwhile."""
    for _ in range(2):  # what the first round lets go may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; -1 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def text_key(text: str) -> Column:
    """Two 64-bit hashes of a text, which with doc_id name a row; equal rows share it."""
    return F.struct(F.xxhash64(F.lit(1), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(text)).alias("b"))
