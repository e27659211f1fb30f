"""Shared pieces: durable cuts of lineage, vectorised word hashing, packed positions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1  #: a null id sorts after every other one
MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_Q = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 20
SWEEP = 3.0
ROWS = 2000  #: of a batch that is sent to a Python worker at most
_swept = 0.0


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of this machine only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not folder:
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lacuna-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that it survives lost executors and isn't computed again.

    What earlier cuts left behind, shuffle files above all, Spark deletes once the driver's garbage is collected. That may not
    happen for long where plans are small, so it is asked for here, every SWEEP seconds at most.
    """
    global _swept
    spark = df.sparkSession
    checkpoint_dir(spark)
    if time.monotonic() - _swept >= SWEEP:
        spark._jvm.System.gc()
        _swept = time.monotonic()
    return df.checkpoint()


def settle(spark: SparkSession) -> None:
    """Collect the executors' garbage, by a task on every core, so that heap which earlier steps grew goes back to the system.

    A heap that has grown stays so, beside the Python workers of what runs next; a full collection shrinks it. Where a core is
    busy its executor may be left out, which changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers ROWS at a time at most, for the rest of the session.

    Spark's 10,000 are tens of MB of texts, which the executor holds outside of its heap, twice while a batch grows, and the
    worker again. A lower setting stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)


def release() -> None:
    """Return freed memory of this process to the system, as far as its library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run):
    """`run` over batches, that returns freed memory at its end: a worker lives on for a minute beside what runs next."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def named(column: str):
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def every(df: DataFrame) -> list:
    return [named(c) for c in df.columns]


def id_key(col: str):
    """The id as a sort key without nulls."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, q in enumerate((_Q, pow(_Q, -1, 2**64))):
                a = np.full(n, q, np.uint64)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
    return _powers


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a buffer that begins and ends at a word boundary."""
    word = ~_WS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    pw, inv = _pow(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every word [^\\x20\\x09-\\x0D]+ of the bytes."""
    found, at = [], 0
    with np.errstate(over="ignore"):
        while at < len(data):
            to = min(len(data), at + _PIECE)
            while to < len(data) and not _WS[data[to]]:
                to += 1
            h, s, e = _hash_piece(np.frombuffer(data, np.uint8, to - at, at))
            found.append((h, s + at, e + at))
            at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def join_texts(texts: list[bytes | None], lower: bool = False) -> tuple[bytes, np.ndarray]:
    """All texts with a blank after each, and where each ends."""
    data = b"".join([x for t in texts for x in (t or b"", b" ")])
    return data.translate(_LOWER) if lower else data, np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each text."""
    data, ends = join_texts(texts, lower)
    h, starts, _ = split_words(data)
    return h, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)


class Table:
    """Numbers 0, 1, .. for 64-bit hashes in the order they come, by open addressing; two words share a number only if
    their hashes are the same, at odds of n * n / 2**65 among n words."""

    def __init__(self):
        self.size, self.bits = 0, 16
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The numbers, -1 for hashes not yet added."""
        mask = (1 << self.bits) - 1
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slots]
        open_ = np.flatnonzero((self.keys[slots] != h) & (out != -1))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & mask
            v = self.values[slots]
            more = (self.keys[slots] != h[open_]) & (v != -1)
            out[open_] = v
            open_, slots = open_[more], slots[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        values = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        if self.size * 3 > 1 << self.bits:
            full = self.values != -1
            h, values = np.concatenate((self.keys[full], h)), np.concatenate((self.values[full], values))
            self.bits = int(np.ceil(np.log2(self.size * 4)))
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        mask = (1 << self.bits) - 1
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.values[slots] == -1)
            _, one = np.unique(slots[free], return_index=True)
            one = free[one]
            self.keys[slots[one]], self.values[slots[one]] = h[one], values[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, values, slots = h[rest], values[rest], slots[rest]
            taken = self.values[slots] != -1
            slots[taken] = (slots[taken] + 1) & mask


def grams(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position on, by doubling; positions too near the end get the largest value."""
    n = len(words)
    out, have = np.zeros(n, np.uint64), 0
    power, span, step = words.copy(), 1, np.uint64(_Q)
    left = length
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                m = n - have
                if m > 0:
                    out[:m] = out[:m] * step + power[have:]
                have += span
            left >>= 1
            if left:
                m = n - span
                if m > 0:
                    power[:m] = power[:m] * step + power[span:]
                step = step * step
                span *= 2
        out = mix(out + np.uint64(length))
    if length > 1:
        out[max(0, n - length + 1) :] = MAX64
    return out


def sliding(a: np.ndarray, width: int, op, pad) -> np.ndarray:
    """op over a[i : i + width], beyond the end filled with pad."""
    out, span = a, 1
    while span < width:
        step = min(span, width - span)
        moved = np.full(len(out), pad, out.dtype)
        moved[: max(0, len(out) - step)] = out[step:]
        out = op(out, moved)
        span += step
    return out


def to_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
