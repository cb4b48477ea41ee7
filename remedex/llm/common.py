"""Shared parts: reading tables, the shared scratch folder, word splitting and rolling hashes in numpy."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedex.sources.settle import shared_folder

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Odd multipliers of the polynomial hashes, and the constants of a 64-bit finaliser.
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written below the shared folder, to cut lineage and to be read more than once.

    A lazy result may read them at any later time, so they stay until the program ends or ``Scratch.clear`` is called by
    one who knows that the results made so far have been written.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
        if not Scratch.made:
            atexit.register(Scratch.clear)
        Scratch.made.append(self)

    @staticmethod
    def clear() -> None:
        while Scratch.made:
            Scratch.made.pop().drop()

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        at = f"{self.path}/{name}"
        schema = df.schema
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def drop(self, name: str = "") -> None:
        delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, unless the session has ended; the cluster cleans its scratch folder then."""
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text) -> F.Column:
    """The words of a text column; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numpy helpers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(33)
    h *= MIX2
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class ByteHash:
    """Polynomial hashes of any byte range of a buffer, after one pass over it."""

    BLOCK = 1 << 20
    _pow = powers(BASE, 1 << 16)
    _inv = powers(inverse(BASE), 1 << 16)

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        cls = ByteHash
        if len(cls._pow) < n:
            size = 1 << (n - 1).bit_length()
            cls._pow, cls._inv = powers(BASE, size), powers(inverse(BASE), size)
        self.sum = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * cls._pow[: n - 1], out=self.sum[1:])

    def of(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[start]) * ByteHash._inv[start])


def concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer and the bounds of each text in it."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), bounds


_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts in a buffer, and the number of words of each text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    gap = _GAP[buf]
    first = np.empty(len(buf), dtype=bool)
    first[0] = True
    first[1:] = gap[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(buf)]
    first[inner] = True
    starts = np.flatnonzero(first & ~gap)
    last = np.empty(len(buf), dtype=bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    at = np.searchsorted(starts, bounds)
    return starts, ends, np.diff(at)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts do not pile up in one.

    All operators want the same bounds, so no result depends on what was called before it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def slices(sizes, limit: int):
    """Ranges of rows whose sizes add up to about ``limit``, each with one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null: empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Lexicon:
    """Pieces of text numbered as they come, with the ids of each in one flat array. ``encode`` gives ids of new pieces."""

    def __init__(self, encode, most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, pieces) -> None:
        """Make sure that all pieces are known."""
        if len(self.number) > self.most:
            self.clear()
        new = [p for p in pieces if p not in self.number]
        if not new:
            return
        flat, sizes = self.encode(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces one after the other, and the number of ids of each."""
        first, n = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(first - ends + n, n)
        return self.flat[at], n


def groups(batches, keys: list[str]):
    """Groups of rows with equal keys, from batches sorted by them; a group may span batches."""
    import pandas as pd

    held: list = []
    for b in batches:
        if not len(b):
            continue
        b = pd.concat([*held, b], ignore_index=True) if held else b
        change = np.zeros(len(b), dtype=bool)
        for k in keys:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(change).tolist(), len(b)]
        at = sorted(set(at))
        for lo, hi in zip(at[:-2], at[1:-1], strict=True):
            yield b.iloc[lo:hi]
        held = [b.iloc[at[-2] :]]
    if held:
        yield held[0]


def gather(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys and sorted by them, for ``groups``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


_KEPT: dict = {}


def kept(key, make):
    """An object of this Python worker, made once and used by its later tasks."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced, and give it the time to."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def separators(digits: bool) -> bytes:
    """A table for ``bytes.translate``: A-Z lower-cased, all ASCII but letters (and digits, if they count) made spaces."""
    kept_ = set(range(97, 123)) | set(range(128, 256)) | (set(range(48, 58)) if digits else set())
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept_ else 32 for b in range(256))


class Numbers:
    """Distinct terms of texts, numbered as they come."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms of the split texts one after the other, and how many each text has."""
        from itertools import chain

        number = self.number
        for w in set().union(*split):
            if w not in number:
                number[w] = len(number)
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        return np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum())), sizes


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))
