"""Language identification by cross-parsing: the language whose sample needs the fewest normalised phrases wins."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .bpe import _batches
from .common import every, release

SAMPLE_DOCS, SAMPLE_CHARS, TEXT_CHARS, MAX_LANGS = 120, 30_000, 250, 256  #: bounds of the labelled sample: many short passages of each language
CLASSES = 256  #: characters told apart at most; the last class is padding, class 0 every other character, which matches none
SEGMENT = 512  #: characters of a text that are parsed side by side with others


def automaton(sample: np.ndarray, classes: int) -> np.ndarray:
    """Suffix automaton of a sequence of classes, as a table with one row of successors per state; -1 where there is none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), classes), -1, np.int32)
    for s, moves in enumerate(nxt):
        if moves:
            table[s, list(moves)] = list(moves.values())
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


class Model:
    """Samples: (language, text) in the order of the languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        coded = [codes(t.lower()) for _, t in samples]
        seen, counts = np.unique(np.concatenate([*coded, np.zeros(0, np.uint32)]), return_counts=True)
        kept = seen[np.lexsort((seen, -counts))][: CLASSES - 2]
        self.n = len(kept) + 2
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[kept] = np.arange(1, len(kept) + 1)
        upper = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c) and len(chr(c).lower()) == 1]
        self.classes[upper] = self.classes[[ord(chr(c).lower()) for c in upper]]
        self.tables, self.bits = [], []
        for x in coded:
            table = automaton(self.classes[x], self.n)
            table[:, 0] = -1
            # one more state, of no open phrase; from there, or where a match ends, a character opens a phrase, which is over
            # at once if the sample lacks it
            closed = len(table)
            opened = np.where(table[0] < 0, closed, table[0]).astype(np.int64)
            moves = np.concatenate((np.where(table < 0, opened[None, :], table), opened[None, :])) * self.n
            moves = moves << 1 | np.concatenate((table < 0, np.ones((1, self.n), bool)))
            moves[:, self.n - 1] = (np.arange(closed + 1) * self.n) << 1
            self.tables.append(moves.astype(np.int64).ravel() if moves.max() > 2**31 - 1 else moves.astype(np.int32).ravel())
            self.bits.append(np.log2(len(x) + 2))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """For each text and language the number of phrases of a greedy parse, times the bits of a pointer into the sample.

        A phrase is the longest match, from where the last one ended, that occurs in the sample; a character that
        doesn't occur is a phrase. Segments are parsed side by side as if no phrase were open, and again from the state
        that the one before ended in, until that is the state they were parsed from.
        """
        coded = [self.classes[codes(t)] for t in texts]
        lens = np.array([len(x) for x in coded], np.int64)
        n_lanes = -(-lens // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n_lanes)
        lanes = np.full((len(owner), SEGMENT), self.n - 1, np.uint8)
        at = 0
        for x, n in zip(coded, n_lanes.tolist(), strict=True):
            lanes[at : at + n].reshape(-1)[: len(x)] = x
            at += n
        first = np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]))
        size = (lanes != self.n - 1).sum(axis=1)
        out = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            closed = len(table) - self.n
            begin = np.full(len(owner), closed, table.dtype)
            end, count = np.zeros_like(begin), np.zeros(len(owner), np.int64)
            todo = np.arange(len(owner))
            while len(todo):
                order = todo[np.argsort(-size[todo], kind="stable")]
                active = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
                steps = np.ascontiguousarray(lanes[order].T).astype(table.dtype)
                state, found = begin[order], np.zeros(len(order), np.int64)
                for t in range(SEGMENT):
                    m = active[t]
                    if not m:
                        break
                    v = table[state[:m] + steps[t, :m]]
                    found[:m] += v & 1
                    state[:m] = v >> 1
                end[order], count[order] = state, found
                want = np.where(first, closed, np.concatenate((end[:1], end[:-1])))
                todo = np.flatnonzero(want != begin)
                begin = want.astype(table.dtype)
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)) * self.bits[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is by how much of its bits the winner beats the next."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = letters()
        live = [i for i, t in enumerate(texts) if t and known[codes(t)].any()]
        if live and self.langs:
            bits = self.phrases([texts[i] for i in live])
            best = bits.argmin(axis=1)
            ordered = np.sort(bits, axis=1)
            margin = 1 - ordered[:, 0] / ordered[:, 1] if bits.shape[1] > 1 else np.ones(len(live))
            scores[live] = np.round(margin, 9)
            for i, b in zip(live, best.tolist(), strict=True):
                langs[i] = self.langs[b]
        return langs, scores


@lru_cache(maxsize=1)  # a worker lives on from one table to the next, and each model takes tens of MB
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """A bounded labelled sample: of each of the MAX_LANGS most frequent languages the SAMPLE_DOCS documents whose hashed
    ids are smallest, up to TEXT_CHARS characters of each and SAMPLE_CHARS in all. Language counts are of all rows."""
    df = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = df.filter("lang is not null and text is not null and length(trim(text)) > 0")
    counts = sorted(((r["lang"], r["count"]) for r in df.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()), key=lambda x: x[0])
    if not counts:
        return ()
    span, keep = 1 << 40, F.lit(False)
    for lang, n in counts:
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.col("h"), F.lit(span)) < int(span * min(1.0, 2 * SAMPLE_DOCS / n))))
    w = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(span)), "text")
    few = df.filter(keep).select("lang", "h", F.substring("text", 1, TEXT_CHARS).alias("text")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE_DOCS)
    found: dict[str, list] = {lang: [] for lang, _ in counts}
    for r in few.collect():
        found[r["lang"]].append((r["k"], r["text"]))
    return tuple((lang, "\n".join(t for _, t in sorted(rows))[:SAMPLE_CHARS]) for lang, rows in found.items() if rows)


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row; with `keep`, also the row itself as a struct.

    The whole text is parsed. A null text, or one without a letter, is `und` with score 0, as is every text where there
    is no sample to learn from. Ties go to the language that comes first by name. Null ids and repeated rows stay.
    """
    text = [F.col(text_col).cast("string").alias("text")]
    at = next((k for k, c in enumerate(docs.columns) if keep and c == text_col and docs.schema[k].dataType == StringType()), -1)
    if keep:
        # the text of a row is sent once
        text = [*(text if at < 0 else []), F.struct(*every(docs)).alias("row")]
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        m = model(samples)
        for whole in batches:
            if at >= 0:
                row = whole.column(1)
                whole = pa.RecordBatch.from_arrays([whole.column(0), row.field(at), row], ["doc_id", "text", "row"])
            for b in _batches(whole):
                langs, scores = m.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), *b.columns[2:]], ["doc_id", "lang_pred", "score", *(["row"] if keep else [])])
        # a worker lives on after its task, for a minute beside what runs next, so it gives back what it can
        whole = b = row = m = None
        model.cache_clear()
        release()

    schema = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), *(f for f in df.schema.fields if f.name == "row")])
    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, sample(docs.filter(~held_out() & F.col("doc_id").isNotNull())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
