"""Exact substring dedup by level-wise doubling: only windows that repeat at one length are extended to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _batches
from .common import MAX64, NULL_ID, cut, grams, hash_words, id_key, mix, sliding

WINDOW = 20
HELD = 1 << 21  #: windows a task holds before it sends them on
_FOUND = "h long, did long, th long, pos int, many boolean, packed binary"
_FLAGS = "did long, th long, pos int, packed binary"


def _pack(did: np.ndarray, th: np.ndarray, pos: np.ndarray):
    """One row per document with its positions as packed 32-bit integers."""
    order = np.lexsort((pos, th, did))
    did, th, pos = did[order], th[order], pos[order].astype("<i4")
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(did)), bool), (did[1:] != did[:-1]) | (th[1:] != th[:-1]))))
    ends = np.append(first[1:], len(did))[: len(first)]
    return did[first], th[first], [pos[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]


def _send(h: np.ndarray, did: np.ndarray, th: np.ndarray, pos: np.ndarray, later: bool):
    """Of the windows of a task only the first of each content goes on; what the task itself has settled is packed.

    That keeps a content which a third of all documents share to one row per task. Settled are, for `later`, the windows
    after the first, and else all that the task holds twice.
    """
    order = np.lexsort((pos, did, h))
    h, did, th, pos = h[order], did[order], th[order], pos[order]
    first = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    many = np.bincount(run, minlength=len(starts))[run] > 1
    after = ~first
    if later:
        after &= (did > did[starts][run]) | (pos > pos[starts][run])
    d, t, packed = _pack(did[after], th[after], pos[after])
    go = np.flatnonzero(~after)
    go = go[np.argsort(order[go])]  # by document again: neighbours then differ in little but the hash, and compress
    n, m = len(go), len(d)
    none = lambda k, kind: pa.nulls(k, kind)
    yield pa.RecordBatch.from_arrays([pa.array(h[go].view(np.int64)), pa.array(did[go]), pa.array(th[go]), pa.array(pos[go].astype(np.int32)), pa.array(many[go]), none(n, pa.binary())], ["h", "did", "th", "pos", "many", "packed"])
    if m:
        with np.errstate(over="ignore"):
            spread = mix(t.astype(np.uint64) + d.astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(d), pa.array(t), none(m, pa.int32()), none(m, pa.bool_()), pa.array(packed, pa.binary())], ["h", "did", "th", "pos", "many", "packed"])


def _settle(found: DataFrame, later: bool) -> DataFrame:
    """Positions per document of the windows that occur twice or, for `later`, after the first place of their content.

    Rows come sorted by content, so only the row before is kept in mind, however often a content occurs.
    """

    def run(batches):
        last = None  # later: (h, did, pos) of the first row of the run; else the row not yet decided

        def out(did, th, pos):
            return pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(pos.astype(np.int32)), pa.nulls(len(did), pa.binary())], ["did", "th", "pos", "packed"])

        for b in batches:
            whole = b.column(5).is_valid()
            if (settled := b.filter(whole)).num_rows:
                yield settled.select(["did", "th", "pos", "packed"])
            b = b.filter(pa.compute.invert(whole))
            if not b.num_rows:
                continue
            h, did, th, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if later:
                first = np.concatenate(([True], h[1:] != h[:-1]))
                at = np.flatnonzero(first)
                run_ = np.cumsum(first) - 1
                d0, p0 = did[at].copy(), pos[at].copy()
                if last is not None and last[0] == h[0]:
                    d0[0], p0[0] = last[1], last[2]
                go = (did > d0[run_]) | ((did == d0[run_]) & (pos > p0[run_]))
                last = (h[-1], d0[-1], p0[-1])
            else:
                many = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
                if last is not None:
                    h, did, th, pos, many = (np.concatenate(([x], y)) for x, y in zip(last, (h, did, th, pos, many), strict=True))
                same = h[1:] == h[:-1]
                go = many.copy()
                go[1:] |= same
                go[:-1] |= same
                last = (h[-1], did[-1], th[-1], pos[-1], bool(go[-1]))
                go[-1] = False
            if go.any():
                yield out(did[go], th[go], pos[go])
        if not later and last is not None and last[4]:
            yield out(*(np.array([x]) for x in last[1:4]))

    rows = found.repartition("h").sortWithinPartitions("h", "did", "pos")
    return rows.mapInArrow(run, _FLAGS).groupBy("did", "th").agg(F.collect_list("pos").alias("pos"), F.collect_list("packed").alias("packed"))


def _starts(pos, packed) -> np.ndarray:
    """All positions of a document, from the list of them and the list of packed ones."""
    found = [np.asarray(pos.values, np.int64)] if pos.is_valid else []
    return np.concatenate([*found, *(np.frombuffer(p, "<i4") for p in packed or ()), np.zeros(0, np.int64)])


def _windows(per: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether `length` words of one document begin at each word."""
    return np.arange(n) + length <= np.repeat(np.cumsum(per), per)


def _anchors(words: np.ndarray, per: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-length grams, the least of them within each window, and whether a gram is the least of some window."""
    half = window // 2
    width = window - half + 1
    g = np.where(_windows(per, len(words), half), grams(words, half), MAX64)
    least = sliding(g, width, np.minimum, MAX64)
    whole = _windows(per, len(words), window)
    most = sliding(np.where(whole, least, np.uint64(0))[::-1], width, np.maximum, np.uint64(0))[::-1]
    return g, least, (most == g) & (g != MAX64)


def _task(look, later: bool):
    """Runs look(words, per document counts, flags) -> (hashes, chosen) over documents and sends what it chooses."""

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for b in _batches(whole):
                words, per = hash_words(b.column(1).to_pylist())
                flags = np.zeros(len(words), bool)
                if b.num_columns > 3:
                    base = np.cumsum(per) - per
                    for at, *marks in zip(base.tolist(), b.column(3), b.column(4).to_pylist(), strict=True):
                        flags[at + _starts(*marks)] = True
                h, chosen = look(words, per, flags)
                at = np.flatnonzero(chosen)
                owner = np.repeat(np.arange(len(per)), per)[at]
                pos = at - (np.cumsum(per) - per)[owner]
                held.append((h[at], b.column(0).to_numpy()[owner], b.column(2).to_numpy()[owner], pos))
                size += len(at)
                if size > HELD:
                    yield from _send(*(np.concatenate(x) for x in zip(*held, strict=True)), later)
                    held, size = [], 0
        if held:
            yield from _send(*(np.concatenate(x) for x in zip(*held, strict=True)), later)

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = docs.select(id_key(id_col).alias("did"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    return df.select("did", "data", F.xxhash64("data").alias("th"))


def _doc_id():
    return F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id")


def repeated(base: DataFrame, window: int, later: bool, placed: DataFrame) -> DataFrame:
    """Packed starts per document of the windows that repeat, or that also start earlier.

    Level one: of each window the half-length gram with the least hash; equal windows have equal ones, so a window
    whose gram occurs once occurs once. Level two: the windows whose gram repeats, at full length.
    """

    def first(words, per, _):
        g, _, chosen = _anchors(words, per, window)
        return g, chosen

    def second(words, per, flags):
        g, least, _ = _anchors(words, per, window)
        alive = sliding(np.where(flags, g, MAX64), window - window // 2 + 1, np.minimum, MAX64) == least
        return grams(words, window), alive & _windows(per, len(words), window)

    halves = _settle(base.mapInArrow(_task(first, False), _FOUND), False)
    grown = placed.join(halves, ["did", "th"]).select("did", "data", "th", "pos", "packed")
    return _settle(grown.mapInArrow(_task(second, later), _FOUND), later)


def longest_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and longest: the greatest window * 2**k words that some window of the document shares with another place.

    Each level extends to twice the length the windows whose two halves both repeat, until none survives.
    """
    base = _base(docs, id_col, text_col)
    placed = base.repartition("did", "th")
    flags = cut(repeated(base, window, False, placed))
    levels, length = [], window
    while not flags.isEmpty():
        levels.append(flags.select("did", "th", F.lit(length).cast("long").alias("longest")))

        def grow(words, per, on, length=length):
            both = on & np.concatenate((on[length:], np.zeros(min(length, len(on)), bool)))
            return grams(words, 2 * length), both & _windows(per, len(words), 2 * length)

        rows = placed.join(flags, ["did", "th"]).select("did", "data", "th", "pos", "packed")
        flags = cut(_settle(rows.mapInArrow(_task(grow, False), _FOUND), False))
        length *= 2
    out = base.select("did", "th")
    if not levels:
        return out.select(_doc_id(), F.lit(0).cast("long").alias("longest"))
    found = levels[0]
    for x in levels[1:]:
        found = found.union(x)
    found = found.groupBy("did", "th").agg(F.max("longest").alias("longest"))
    return out.join(found, ["did", "th"], "left").select(_doc_id(), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `texts`, kept: the words left, joined by one blank.

    A word goes if a window of `window` words of its document covers it whose words also start earlier: in a document
    with a smaller id, or earlier in this one. Windows are judged on the input. Doubling stops at `window`, as longer
    repeats are covered by windows of that length; `longest_repeats` goes on.

    A null text has no words. A null id comes after every other. Rows with the same id and place are neither earlier nor
    later than each other, so repeated rows get the same result. Other columns are left out; an empty table gives no rows.
    """
    base = _base(docs, id_col, text_col)
    placed = base.repartition("did", "th")
    gone = repeated(base, window, True, placed)

    def keep(batches):
        for whole in batches:
            for b in _batches(whole):
                n_words, n_removed, sha, kept = [], [], [], []
                for data, *marks in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    words = (data or b"").split()
                    n_words.append(len(words))
                    starts = _starts(*marks)
                    if len(starts):
                        change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)[: len(words) + 1]
                        left = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                        words = [words[i] for i in left.tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    text = b" ".join(words)
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text if texts else None)
                out = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
                names = ["did", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    out, names = [*out, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(out, names)

    rows = placed.join(gone, ["did", "th"], "left").select("did", "data", "pos", "packed")
    rows = rows.mapInArrow(keep, "did long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return rows.select(_doc_id(), *rows.columns[1:])


def op1_substring(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
