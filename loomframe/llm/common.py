"""Shared pieces of the corpus operators: text batches as byte buffers, vectorised rolling hashes, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; everything else is part of a word.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one vectorised step works on, which bounds a Python worker's memory.
STEP_BYTES = 1 << 20

_U = np.uint64
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id", mod: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor and the driver can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/loomframe-shared"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here, and lost executors cost nothing.

    The folder is deleted when the driver's JVM ends; `drop_stored` does so earlier. On a local disk without Hadoop's native
    library, each file and folder written starts a process (chmod) from the JVM, so tables that are read once stay plans, and
    no file marks success: the table is used only after the write has returned.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    place, files = _hadoop(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing reads any more."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place, files = _hadoop(df.sparkSession, file)
            files.delete(place, True)


def fresh(columns: list[str], name: str) -> str:
    """The name, with as many underscores in front as tell it from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_number_key(docs: DataFrame, key: str) -> Column:
    """The key as a long; a key of another kind is refused, as operators compare ids by size."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} must be a whole number, not {kind.simpleString()}")
    return F.col(key).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as (bytes, offsets with one more than rows); no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes in `column` (or one row)."""
    _, offsets = byte_view(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in pieces_of(batch, column):
            data, offsets = byte_view(part.column(column))
            yield part, data, offsets


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a symbol sequence, from prefix sums.

    hash(s, e) depends on the symbols s..e-1 alone, so equal ranges agree wherever they stand. There are short strings
    that this modulus can't tell apart, so these hashes may route, and nothing may rest on their equality.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power = np.full(n + 1, self.BASE, _U)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(symbols * power[:n], out=self.sums[1:])
        inverse = np.full(n + 1, pow(self.BASE, -1, 1 << 64), _U)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k symbols."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, _U)


PRIME = (1 << 61) - 1
_P, _30, _31 = _U(PRIME), _U((1 << 30) - 1), _U((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for values below it, from 31-bit halves."""
    a1, a0, b1, b0 = a >> _U(31), a & _31, b >> _U(31), b & _31
    cross = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << _U(1)) + (cross >> _U(30)) + ((cross & _30) << _U(31)) + a0 * b0)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**61 - 1; a worker keeps the longest table it needed."""
    known = _POWERS.get(base, np.ones(1, _U))
    while len(known) < n:
        known = np.concatenate([known, times(known, np.array(pow(base, len(known), PRIME), _U))])
    _POWERS[base] = known
    return known[:n]


class PrimeRolling:
    """Polynomial hashes modulo the prime 2**61 - 1: two different ranges of n symbols agree with probability n / 2**61.

    Symbols are taken modulo the prime. The base is fixed, so that workers agree.
    """

    def __init__(self, symbols: np.ndarray, base: int = 0x0B6D5C2F9A371E85):
        self.inverse = powers(pow(base, -1, PRIME), len(symbols) + 1)
        value = times(_reduced(symbols.astype(_U, copy=False)), powers(base, len(symbols)))
        low, high = np.cumsum(value & _31), np.cumsum(value >> _U(31))
        self.sums = np.zeros(len(symbols) + 1, _U)
        self.sums[1:] = _reduced((high >> _U(30)) + ((high & _30) << _U(31)) + low)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(times(_reduced(self.sums[end] + _P - self.sums[start]), self.inverse[start]))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k symbols."""
        n = len(self.sums) - k
        return self.of(np.s_[:n], np.s_[k:]) if n > 0 else np.zeros(0, _U)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; works on its argument, which must not be used elsewhere."""
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


#: A random odd number for each byte.
BYTE_CODES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of each text, and the words before each text."""
    inside = ~_SPACE[data]
    first = np.empty(len(data) + 1, bool)
    first[0] = True
    first[1:] = ~np.append(inside[:-1], False) if len(data) else True
    first = first[: len(data)]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data), bool)
    if len(data):
        last[:-1] = ~inside[1:]
        last[-1] = True
        last[edge[edge > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that count as one symbol, and the most symbols that are taken one after another.
CHUNK, CHUNKS = 7, 8
_WORD_BASE = _U(0x13A7C9E2D45B8F61)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given byte ranges, modulo 2**61 - 1 and spread over 64 bits: polynomials over the length and symbols of
    seven bytes, or, for the few longer than `CHUNKS` of these, over bytes."""
    size = ends - starts
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))
    h = size.astype(_U)
    for k in range(CHUNKS):
        at = np.flatnonzero(size > CHUNK * k) if k else np.s_[:]
        left = size[at] - CHUNK * k
        if not len(left):
            break
        symbol = eight[starts[at] + CHUNK * k] & ((_U(1) << (_U(8) * np.minimum(left, CHUNK).astype(_U))) - _U(1))
        h[at] = _reduced(times(h[at], _WORD_BASE) + symbol)
    for i in np.flatnonzero(size > CHUNK * CHUNKS).tolist():
        own = PrimeRolling(BYTE_CODES[data[starts[i] : ends[i]]], int(_WORD_BASE))
        h[i] = own.of(np.array([0]), size[i : i + 1])[0] & _P
    return mixed(h)


def within(offsets: np.ndarray) -> np.ndarray:
    """The number of the row that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
