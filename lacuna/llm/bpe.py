"""Byte-level BPE: many pieces at once in padded matrices, merged by rank; and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
LONG = 4096  #: pieces beyond this take a heap of pairs, as a matrix row would cost the square of its length
CACHE = 400_000  #: pieces a worker remembers; beyond it the memory starts anew
_WS = "\t-\r \x85\xa0  -     　"
#: A chunk holds whole matches of the pattern, as none goes on over white space but for one leading blank.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, .. of all runs in a row."""
    total = int(lens.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


class Ranks:
    """A vocabulary of ranks with hashed lookup of the pairs that merge."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for k, v in self.rank.items():
            self.bytes[v] = k
        self.text = [str(i) for i in range(len(self.bytes))]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.final = self.single
        pairs = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self._hash(pairs)
        self.forget()

    def _hash(self, pairs: dict[int, int]) -> None:
        """Open addressing of pairs (left << 20 | right) to what they merge to."""
        self.bits = max(10, int(np.ceil(np.log2(len(pairs) + 1))) + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            _, one = np.unique(np.where(free, slots, -1), return_index=True)
            one = one[free[one]]
            self.keys[slots[one]], self.values[slots[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, slots = keys[rest], values[rest], slots[rest]
            taken = self.keys[slots] != -1
            slots[taken] = (slots[taken] + 1) & ((1 << self.bits) - 1)

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair doesn't merge."""
        keys = a.astype(np.int64) << 20 | b
        slots = self._slot(keys)
        out, at = self.values[slots], self.keys[slots]
        open_ = np.flatnonzero((at != keys) & (at != -1))
        out[at != keys] = NONE
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def _rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most `width` bytes: each round, every row merges its leftmost pair of least rank."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = self.single[raw]
        ids[np.arange(n), lens - 1] = self.final[raw[np.arange(n), lens - 1]]
        col = np.arange(width)
        ranks = np.full((n, width), NONE, np.int32)
        r, c = np.nonzero(col[None, :] < (lens - 1)[:, None])
        ranks[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
        out, out_lens, name = np.zeros((n, width), np.int32), lens.copy(), np.arange(n)
        while len(name):
            best = ranks.argmin(axis=1)
            every = np.arange(len(name))
            value = ranks[every, best]
            done = value == NONE
            if done.any():
                out[name[done], : ids.shape[1]] = ids[done]
                out_lens[name[done]] = lens[done]
                live = ~done
                ids, ranks, lens, name, best, value = ids[live], ranks[live], lens[live], name[live], best[live], value[live]
                if not len(name):
                    break
                used = int(lens.max())
                ids, ranks, col = ids[:, :used], ranks[:, :used], col[:used]
                every = np.arange(len(name))
            after = col[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[every, best] = value
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            lens -= 1
            ranks[every, lens - 1] = NONE
            i = np.flatnonzero(best < lens - 1)
            ranks[i, best[i]] = self.lookup(ids[i, best[i]], ids[i, best[i] + 1])
            i = np.flatnonzero((best > 0) & (best - 1 < lens - 1))
            ranks[i, best[i] - 1] = self.lookup(ids[i, best[i] - 1], ids[i, best[i]])
        return out[np.arange(width)[None, :] < out_lens[:, None]], out_lens

    def _long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap over linked parts."""
        parts: list = [piece[i : i + 1] for i in range(len(piece))]
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < len(parts) and (r := self.rank.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.rank[p] for p in parts if p is not None]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and how many each has; pieces of like length share a matrix."""
        buckets: dict[int, list[int]] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole, whole_ids = [], []
        for i, p in enumerate(pieces):
            n = len(p)
            if (r := self.rank.get(p)) is not None:
                whole.append(i)
                whole_ids.append(r)
            elif n > LONG:
                ids = np.array(self._long(p), np.int32)
                parts.append((np.array([i]), ids, np.array([len(ids)])))
            elif n:
                buckets.setdefault(n + n % 2 if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        parts.append((np.array(whole, np.int64), np.array(whole_ids, np.int32), np.ones(len(whole), np.int64)))
        for width, members in buckets.items():
            step = max(1, (1 << 18) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                parts.append((np.array(part), *self._rows([pieces[i] for i in part], width)))
        owner, lens = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        counts = np.zeros(len(pieces), np.int64)
        counts[owner] = lens
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        flat[spread(starts[owner], lens)] = np.concatenate([p[1] for p in parts])
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and how many each has; each match of the pattern is merged by itself."""
        chunked = [_CHUNK.findall(t) for t in texts]
        if len(self.cache) > CACHE:
            self.forget()
        cache = self.cache
        new = [c for c in set().union(*chunked) if c not in cache]
        if new:
            split = [self.pattern.findall(c) for c in new]
            unique: dict[str, int] = {}
            order = np.array([unique.setdefault(p, len(unique)) for ps in split for p in ps], np.int64)
            flat, counts = self.encode_pieces([p.encode() for p in unique])
            at = np.cumsum(counts) - counts
            ids = flat[spread(at[order], counts[order])]
            sums = np.concatenate(([0], np.cumsum(counts[order])))
            edges = sums[np.concatenate(([0], np.cumsum([len(ps) for ps in split])))]
            self.starts = np.concatenate((self.starts, len(self.flat) + edges[:-1]))
            self.lens = np.concatenate((self.lens, np.diff(edges)))
            self.flat = np.concatenate((self.flat, ids))
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        chunks = np.array([cache[c] for cs in chunked for c in cs], np.int64)
        lens = self.lens[chunks]
        sums = np.concatenate(([0], np.cumsum(lens)))
        edges = np.concatenate(([0], np.cumsum([len(cs) for cs in chunked])))
        return self.flat[spread(self.starts[chunks], lens)], np.diff(sums[edges])

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def vocabulary(name: str) -> tuple[str, str]:
    """Path of an installed rank file, and the pattern its texts are split by."""
    import public_tokenizers as P

    return P.path(name), P.PATTERN


def _batches(b, size: int = 1 << 21):
    """Slices of a batch with about so many characters of text."""
    import pyarrow.compute as pc

    lens = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(lens) // size, prepend=0)) if len(lens) else []
    edges = sorted({0, *map(int, cuts), b.num_rows})
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield b.slice(lo, hi - lo)


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text. Special tokens are ordinary text.

    A null or empty text has no ids. Ids that are null and repeated rows stay; other columns are left out.
    """

    def run(batches):
        bpe = ranks(*vocabulary(name))
        for whole in batches:
            for b in _batches(whole):
                ids, counts = bpe.encode([t or "" for t in b.column(1).to_pylist()])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids and the bytes they stand for."""

    def run(batches):
        bpe = ranks(*vocabulary(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def digest(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Encodes, decodes the ids again, and keeps counts and digests of both."""

    def run(batches):
        bpe = ranks(*vocabulary(name))
        text = bpe.text
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for b in _batches(whole):
                flat, counts = bpe.encode([t or "" for t in b.column(1).to_pylist()])
                ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(map(len, ids), pa.int64()),
                        pa.array([sha(",".join([text[i] for i in x]).encode()) for x in ids]),
                        pa.array([sha(bpe.decode(x)) for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
