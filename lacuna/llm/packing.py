"""Packing: shards of documents, each with a BM25 index that finds unused neighbours to fill a seed's window."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, Ranks, _batches, spread
from .common import Table, join_texts, releasing, split_words

WINDOW, END = 4096, 2
SHARD_TOKENS = 1 << 20  #: a shard is closed by the document that takes it beyond this
TASK_BYTES = 1 << 21  #: small input partitions are packed together, so that each task has about this much text or more
K1, B = 1.2, 0.75
CACHE = 1_500_000  #: words a worker remembers the ids of
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Merges(Ranks):
    """The merges of a tokenizer file with word ends; an id is the smaller the earlier its merge."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        name, spare = {b: chr(b) for b in printable}, iter(range(256, 512))
        name |= {b: chr(next(spare)) for b in range(256) if b not in name}
        self.single = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[name[b] + end] for b in range(256)], np.int32)
        self.rank, pairs, last = {}, {}, -1
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merged = vocab[a + b]
            if merged <= last:
                raise ValueError("ids don't follow the order of merges")
            pairs[vocab[a] << 20 | vocab[b]] = last = merged
        self._hash(pairs)


#: A word that the file's rules change in no other way than to lower case: of plain letters, digits and marks.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch


class Words:
    """Ids of texts, from the ids of their words: nothing in the vocabulary's rules reaches over white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(path)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.flat, self.starts, self.lens = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        if self.table.size > CACHE:
            self.forget()
        data, text_ends = join_texts(texts)
        hashes, at, to = split_words(data)
        numbers = self.table.get(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            _, first = np.unique(hashes[missing], return_index=True)
            plain, other = [], []
            for i in missing[np.sort(first)].tolist():
                t = data[at[i] : to[i]].decode()
                (plain if to[i] - at[i] < LONG // 2 and _PLAIN(t) else other).append((i, t))
            split_ = [self.pattern.findall(t.lower()) for _, t in plain]
            unique: dict[str, int] = {}
            order = np.array([unique.setdefault(p, len(unique)) for ps in split_ for p in ps], np.int64)
            flat, counts = self.merges.encode_pieces([p.encode() for p in unique])
            place = np.cumsum(counts) - counts
            sums = np.concatenate(([0], np.cumsum(counts[order])))[np.concatenate(([0], np.cumsum([len(ps) for ps in split_], dtype=np.int64)))]
            rest = [e.ids for e in self.tokenizer.encode_batch([t for _, t in other], add_special_tokens=False)]
            lens = np.concatenate((np.diff(sums), np.array([len(x) for x in rest], np.int64)))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
            self.lens = np.concatenate((self.lens, lens))
            self.flat = np.concatenate((self.flat, flat[spread(place[order], counts[order])].astype(np.uint16), np.array([i for x in rest for i in x], np.uint16)))
            self.table.add(hashes[[i for i, _ in plain + other]])
            numbers[missing] = self.table.get(hashes[missing])
        lens = self.lens[numbers]
        sums = np.concatenate(([0], np.cumsum(lens)))[np.searchsorted(at, np.concatenate(([0], text_ends)))]
        return self.flat[spread(self.starts[numbers], lens)], np.diff(sums)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lens = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate(docs).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(n, dtype=np.uint64), lens)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(np.append(first, len(key)))
        self.terms, self.docs = (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.edges = np.searchsorted(self.terms, np.arange(65_537))
        df = np.diff(self.edges)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lens / max(1.0, lens.mean()))
        self.weight = self.idf[self.terms] * tf * (K1 + 1) / (tf + norm[self.docs])
        own = np.argsort(self.docs, kind="stable")
        self.own, self.own_edges = own, np.searchsorted(self.docs[own], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share any term with the seed, best first by all its terms; ties by place."""
        mine = self.own[self.own_edges[seed] : self.own_edges[seed + 1]]
        df = np.diff(self.edges)[self.terms[mine]]
        mine = mine[df > 1]
        terms = self.terms[mine]
        at = spread(self.edges[terms], self.edges[terms + 1] - self.edges[terms])
        score = np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; every sequence but the last is full.

    The longest unused document is the seed. Its unused neighbours follow, best first, and the one that reaches the end
    of the window is cut there: what is left of it is the next seed.
    """
    lens = [len(d) for d in docs]
    index = Index(docs)
    used = np.zeros(len(docs), bool)
    order = iter(sorted(range(len(docs)), key=lambda i: (-lens[i], i)))
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0

    def put(doc: int) -> bool:
        """Whether the document was cut: then it has opened another sequence."""
        nonlocal sequence, offset
        start, fresh = 0, False
        while start < lens[doc]:
            n = min(lens[doc] - start, window - offset)
            pieces.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset, fresh = sequence + 1, 0, True
        return fresh

    for seed in order:
        if used[seed]:
            continue
        used[seed] = True
        put(seed)
        while seed is not None and offset:
            found = index.neighbours(seed)
            seed = None
            for doc in found[~used[found]].tolist():
                used[doc] = True
                if put(doc):
                    seed = doc
                    break
    return pieces


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. A sequence is a window of one shard: a run of the documents of one input partition.

    A null or empty text is its end id alone. Null ids and repeated rows are packed like others; other columns are left
    out. Only the last sequence of a shard is short of the window, and is padded. Neighbouring input partitions are taken
    together, without a shuffle, until they hold some hundred windows, so that padding doesn't depend on file layout.
    """
    if path is None:
        import public_tokenizers as P

        path = P.path("word_bpe_49k.json")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        coder = words(path)
        ids: list = []
        docs: list[np.ndarray] = []
        size = done = 0

        def shard():
            nonlocal ids, docs, size, done
            pieces = pack(docs)
            crc = [zlib.crc32(docs[d][s : s + n].astype("<u4")) for d, s, n, _, _ in pieces]
            owner, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            total = np.array([len(d) for d in docs], np.int64)[owner]
            out = pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in owner], pa.int64()), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (total, base + done + seq, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            done += int(seq.max()) + 1
            ids, docs, size = [], [], 0
            return out

        for whole in batches:
            for b in _batches(whole):
                flat, counts = coder.encode([t or b"" for t in b.column(1).to_pylist()])
                edges = np.cumsum(counts) - counts
                for i, at, n in zip(b.column(0).to_pylist(), edges.tolist(), counts.tolist(), strict=True):
                    ids.append(i)
                    docs.append(np.append(flat[at : at + n], np.uint16(END)))
                    size += n + 1
                    if size >= SHARD_TOKENS:
                        yield shard()
        if docs:
            yield shard()

    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    docs = docs.coalesce(min(2**31 - 1, max(1, total // TASK_BYTES)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("data")).mapInArrow(releasing(run), _SCHEMA)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
