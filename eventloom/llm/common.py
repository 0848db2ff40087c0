"""Shared storage, text and file helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. One of the machine's own only where that is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "eventloom-shared")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in the Arrow batches between Spark and Python: texts are long, and an executor holds several batches at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/eventloom-{what}-{uuid.uuid4().hex}"


#: Folders to be deleted when the innermost ``scratch`` ends.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, what: str = "table", kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor never repeats what came before, and lets column
    pruning reach the stored columns, which ``checkpoint()`` would not. Inside ``scratch`` the
    table goes when that ends, unless it is ``kept``.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    if _OPEN and not kept:
        _OPEN[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables stored within it; what is returned from it may read only tables that were ``kept``."""
    _OPEN.append([])
    try:
        yield
    finally:
        delete(spark, *_OPEN.pop())


def delete(spark: SparkSession, *folders: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that is no column of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with computed ones."""
    return df.select(*[F.col(n) for n in names])


def open_fs(uri: str):
    """(file system, path) of a folder for Python tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def dictionary_of(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes trained on the samples; few or alike samples, on which training fails, make one of their plain content."""
    import zstandard

    parts = samples if len(samples) >= 64 else [s[i : i + 256] for s in samples for i in range(0, len(s), 256)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        joined = b"".join(samples)[-size:]
        return (joined * (1 + 64 // max(1, len(joined))))[:size]


def fmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values; wraps on overflow."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_P = 0x9E3779B97F4A7C15
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        p, q = np.full(m, _P, dtype=np.uint64), np.full(m, pow(_P, -1, 1 << 64), dtype=np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW[:n], _INV[:n]


class SpanHasher:
    """64-bit hashes of ``data[s:e]`` for many spans, equal content giving equal hashes in any batch."""

    def __init__(self, data: np.ndarray):
        pw, self.inverse = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return fmix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_P))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(data)(starts, ends)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` over all pairs."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - at, lengths)


def give_back() -> None:
    """Return freed memory to the system: a worker serves one stage after the other, and each would keep its peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_batches(batches, column: int = 1, most: int = 1_000_000):
    """Row groups of Arrow batches as lists of columns, each of about ``most`` characters; null texts are empty.

    A single longer text makes a group of its own, so memory follows the longest text; what was
    freed goes back to the system after the last batch.
    """
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - 1).clip(0) // most if len(sizes) else sizes
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(sizes)]])):
            if b > a:
                part = batch.slice(int(a), int(b - a))
                columns = [part.column(i) for i in range(part.num_columns)]
                columns[column] = [t or "" for t in columns[column].to_pylist()]
                yield columns
    give_back()


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts, starts and ends of their words, number of words of each text).

    Words are runs of letters and digits; Latin-1 and general punctuation separates them.
    """
    blobs = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(blobs) + b"\n\n\n", dtype=np.uint8)
    inside = _WORD[raw]
    for lead, second, size in ((0xE2, 0x80, 3), (0xC2, None, 2)):
        at = np.flatnonzero(raw[:-2] == lead)
        if second is not None:
            at = at[raw[at + 1] == second]
        for k in range(size):
            inside[at + k] = False
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = change[::2], change[1::2]
    edge = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    return raw, starts, ends, np.diff(np.searchsorted(starts, edge))


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of ``bits`` bits, at any size of the input, that has the bit of every id set.

    It lets a scan drop most rows of other ids before a join; what passes still has to be joined.
    Only the words with a bit set travel, at most ``bits / 64`` of them.
    """

    def run(batches):
        import pyarrow as pa

        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            at = fmix(batch.column(0).to_numpy(zero_copy_only=False)) & np.uint64(bits - 1)
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["word", "bits"])

    rows = ids.filter(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = fmix(ids) & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
