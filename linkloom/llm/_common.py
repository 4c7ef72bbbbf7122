"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to Python at once while something is cut: texts and sets are long.
BATCH = 256


def ship(spark: SparkSession) -> None:
    """Python workers import this package from the path the driver has it at."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Workers live on between tasks: what they no longer use goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, and only if Spark runs in one process:
    elsewhere driver and executors share no folder that this could guess."""
    sc = spark.sparkContext
    if top := sc.getConf().get("spark.checkpoint.dir", ""):
        return top.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir; its lineage ends there.

    by: a column that the rows are dealt by; later joins on it find them in place and don't shuffle them again (the
    plan keeps that knowledge only without adaptive execution, which is off while it is made). Collecting garbage lets
    Spark delete the shuffle files of what was cut before, and what was cut itself where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    for_now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}
    if by is not None:
        df = df.repartition(shuffle_parts(spark), by)
        for_now["spark.sql.adaptive.enabled"] = "false"
    before = {k: spark.conf.get(k) for k in for_now}
    try:
        for k, v in for_now.items():
            spark.conf.set(k, v)
        out = df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    gc.collect()
    sc._jvm.System.gc()
    return out


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df, an aggregate by key, dealt otherwise than by key: a join on key then deals both its sides itself, and only
    then Spark can split a side with a hot key, or send the aggregate to all tasks if it is small."""
    return df.repartition(F.xxhash64(key))


def shuffle_parts(spark: SparkSession, factor: int = 1) -> int:
    return max(1, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(df: DataFrame, *cols: str, text_col: str = "text") -> DataFrame:
    """Only the columns that an operator needs; a null text counts as empty."""
    return df.select(*cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one piece, and where each row begins (one more for the end)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about limit bytes, at least one row each."""
    data, offs = raw(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def edges_between(flags: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true flags; a run ends where a row does."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, flags[:-1]
    after[-1], after[:-1] = False, flags[1:]
    full = offs[:-1] < offs[1:]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


#: Word bytes: all but space and 0x09 to 0x0D.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
U64 = np.uint64


def between_words(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """One text in pieces of about limit bytes that end with white space; only a longer word makes a longer piece."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        if hi < n:
            gaps = np.flatnonzero(~WORD[data[lo:hi]])
            while not len(gaps) and hi < n:
                at, hi = hi, min(n, hi + limit)
                gaps = np.flatnonzero(~WORD[data[at:hi]]) + at - lo
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else n
        yield data[lo:hi]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


STEP = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[begin:end], by differences of a running polynomial."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * powers(STEP, n), out=total[1:])
    return mix((total[ends] - total[begins]) * powers(pow(STEP, -1, 1 << 64), n + 1)[begins] + (ends - begins).astype(U64))


LETTER, DIGIT, OTHER, GAP, SPACE = range(5)


@lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for plane in range(17):
        s = "".join(map(chr, (x for x in range(plane << 16, plane + 1 << 16) if not 0xD800 <= x < 0xE000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (GAP, r"\s+")):
            for m in regex.finditer(pattern, s):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind  # runs hold no surrogates
    out[32] = SPACE
    return out
