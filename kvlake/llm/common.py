"""Helpers that the training-data operators share: tables, scratch space, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.sources.scratch import shared_root

# ---------------------------------------------------------------- tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as documents are long; an own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


class Scratch:
    """Tables in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a table is broadcast.
MOST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a table of fixed width whose counted rows stay below the limit; beyond it Spark shuffles."""
    if not all(f.dataType.simpleString() in _FIXED for f in df.schema.fields):
        raise ValueError("the size of columns without a fixed width has to be measured: measured_side")
    return F.broadcast(df) if rows <= limit and rows * 8 * len(df.columns) <= MOST_BYTES else df


_FIXED = ("bigint", "int", "double", "boolean")


def measured_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a table whose rows and bytes, strings and arrays of integers included, are measured to be few."""
    sizes = [F.octet_length(f.name) if f.dataType.simpleString() == "string" else F.lit(8) if f.dataType.simpleString() in _FIXED else 8 * F.size(f.name) for f in df.schema.fields]
    total = F.lit(0).cast("long")
    for s in sizes:
        total = total + F.greatest(F.coalesce(s, F.lit(0)), F.lit(8))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= MOST_BYTES else df


_MADE: dict = {}


def made_in_task(spark: SparkSession, make):
    """make() run once per application, in a task of its own, where numpy keeps to one thread."""
    import pickle

    import pyarrow as pa

    key = (spark.sparkContext.applicationId, make.__module__, make.__name__)
    if key not in _MADE:

        def run(batches):
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make())], pa.binary())], ["made"])

        _MADE[key] = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "made binary").first()[0])
    return _MADE[key]


# ---------------------------------------------------------------- words

#: Separators of words: space and 0x09 to 0x0D.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
WORD = r"[^\x20\x09-\x0D]+"

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 4 + 3  # odd: it has an inverse modulo 2**64
_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_POWERS: list[np.ndarray] = []
#: Odd factors, one for each place in a window.
PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base % (1 << 64))
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some documents: byte places, owner and 64-bit hash of each.

    data: UTF-8 bytes; offsets: where each document begins, and the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        n_docs, n = len(offsets) - 1, len(data)
        self.data, self.offsets, self.n_docs = data, offsets, n_docs
        sep = _SEPARATOR[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[:n]
        start = ~sep
        start[1:] &= sep[:-1] | first[1:]
        end = ~sep  # last byte of a word
        end[:-1] &= sep[1:] | first[1:]
        self.sep = sep
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=n_docs)[:n_docs]
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        if n:
            power, inverse = _powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
            self.sums, self.inverse = sums, inverse
            self.hash = self.span_hash(self.start, self.end)
        else:
            self.hash = np.zeros(0, np.uint64)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end (exclusive), wherever they stand."""
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of so many words within one document."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += self.hash[k : k + n] * PLACES[k]
        return at, mix64(out[at])

    def shingle_sets(self, size: int) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each document; a shorter document is one shingle."""
        at, h = self.windows(size)
        owner = self.doc[at]
        bounds = np.searchsorted(owner, np.arange(self.n_docs + 1))
        out = []
        for d in range(self.n_docs):
            n = int(self.counts[d])
            if n >= size:
                out.append(np.unique(h[bounds[d] : bounds[d + 1]]))
            elif n:
                w = self.hash[self.first[d] : self.first[d + 1]]
                one = np.sum(w * PLACES[:n], dtype=np.uint64, keepdims=True) + PLACES[40:41] * np.uint64(n)
                out.append(mix64(one))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8).copy()
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    return data, offsets


def small_slices(batch, column: str = "text", most: int = 1 << 18):
    """Slices of an Arrow batch with about so many bytes of text, never less than a row."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
