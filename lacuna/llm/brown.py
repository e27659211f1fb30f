"""Scoring by a class-based bigram model: exchange clustering of words, class transitions, word emissions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _batches
from .common import cut, hash_words, id_key, join_texts, releasing, settle, small_batches, split_words

HEAD, BINS = 1 << 20, 16  #: the most frequent words, whose counts go to every task, at most; bins of counts per factor of two
ITEMS, TAILS = 1000, 128  #: words exchanged together on the driver; groups of rare words by their last two bytes
LEAST = 8  #: a word that occurs as often is placed in a class by its own counts; one beyond the head (a far word) by joins
CLASSES, PASSES = 48, 30
DELTA = 0.1  #: added to every count
END = np.uint64(0x5E0D_0F_7E47)  #: the end token's hash


def _tail(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of words of a word, by its last two bytes."""
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return ((last * 257 + before) * 40503 >> 4) % TAILS


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and group of every token of all texts in a row, and the number of each text; the end is a token."""
    data, text_ends = join_texts(texts, lower=True)
    h, s, e = split_words(data)
    group = _tail(np.frombuffer(data, np.uint8), s, e)
    per = np.bincount(np.searchsorted(text_ends, s, side="right"), minlength=len(texts))
    at = np.cumsum(per)
    return np.insert(h, at, END), np.insert(group, at, TAILS), per + 1


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(counts: np.ndarray, r: np.ndarray, l: np.ndarray, own: float) -> np.ndarray:  # noqa: E741
    """What an item outside of all classes, with r pairs to and l pairs from them and `own` with itself, adds to the
    likelihood of the class bigrams `counts` in each class."""
    rows, cols, diag = counts.sum(axis=1), counts.sum(axis=0), counts.diagonal()
    gain = (_f(counts + r[None, :]) - _f(counts)).sum(axis=1) + (_f(counts + l[:, None]) - _f(counts)).sum(axis=0)
    gain += _f(diag + r + l + own) - _f(diag + r) - _f(diag + l) + _f(diag)
    return gain - (_f(rows + r.sum() + own) - _f(rows) + _f(cols + l.sum() + own) - _f(cols))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item from the counts of ordered pairs, and the counts of pairs of classes: items move, one at a
    time, to the class that most raises the likelihood of the class bigrams, until a pass moves none (or `passes`, so
    that the driver's time is bounded). The last item (the end) keeps a class of its own."""
    n = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total[:-1], kind="stable")
    k = max(1, min(classes - 1, n - 1))
    cls = np.zeros(n, np.int64)
    cls[order] = np.arange(n - 1) % k
    cls[n - 1] = k
    one = np.eye(k + 1)[cls]
    counts = one.T @ pairs @ one
    right, left = pairs @ one, pairs.T @ one
    for _ in range(passes):
        moved = 0
        for i in order.tolist():
            old, own = cls[i], pairs[i, i]
            r, l = right[i].copy(), left[i].copy()  # noqa: E741
            r[old] -= own
            l[old] -= own
            counts[old] -= r
            counts[:, old] -= l
            counts[old, old] -= own
            gain = _gain(counts, r, l, own)
            new = int(np.argmax(gain[:k]))
            new = old if gain[new] <= gain[old] + 1e-9 else new
            counts[new] += r
            counts[:, new] += l
            counts[new, new] += own
            if new != old:
                moved += 1
                cls[i] = new
                right[:, old] -= pairs[:, i]
                right[:, new] += pairs[:, i]
                left[:, old] -= pairs[i]
                left[:, new] += pairs[i]
        if not moved:
            break
    return cls, counts


class Model:
    """Counts of the training tokens, the classes, and their logarithms.

    Every worker holds the head, so it is kept in small types: 15 bytes a word, 19 until the items have classes.
    """

    def __init__(self, head: tuple[np.ndarray, np.ndarray, np.ndarray], n_tokens: int, n_distinct: int, groups: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(head[0])
        wide = np.int64 if len(order) and head[1].max() >= 2**31 else np.int32
        self.head, self.head_counts, self.head_group = (x[order].astype(t, copy=False) for x, t in zip(head, (np.uint64, wide, np.uint8), strict=True))
        rank = np.lexsort((self.head, -self.head_counts))
        rank = rank[self.head[rank] != END]
        self.core = rank[:ITEMS]
        self.item = np.full(len(self.head), -1, np.int32)
        self.item[self.core] = np.arange(len(self.core))
        self.n_items = len(self.core) + TAILS + 1
        self.n, self.v = n_tokens, n_distinct
        self.group_n, self.group_v = (x.copy() for x in groups)
        self.far: dict[str, np.ndarray] = {}  # counts (n) and numbers (v) of the far words by group and by class

    @property
    def rest(self) -> np.ndarray:
        """Places in the head of the words to place by their own counts."""
        own = (self.head_counts >= LEAST) & (self.head != END)
        own[self.core] = False
        return np.flatnonzero(own)

    @property
    def word_emit(self) -> np.ndarray:
        """The words' probabilities within their classes, of those with a class of their own."""
        return np.log10(self.head_counts + DELTA) - self.z[self.word_class]

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head of each token, -1 if it isn't there, and its count (-1)."""
        at = np.full(len(h), -1, np.int64)
        if not len(self.head):
            return at, at.copy()
        if not hasattr(self, "first"):  # where the hashes of each run of upper bits begin; made in each task, not sent
            bits = max(1, len(self.head).bit_length() - 1)
            self.shift = np.uint64(64 - bits)
            self.first = np.zeros((1 << bits) + 1, np.int32)
            np.cumsum(np.bincount((self.head >> self.shift).astype(np.int32), minlength=1 << bits), out=self.first[1:])
        run = (h >> self.shift).astype(np.int64)
        pos, end = self.first[run], self.first[run + 1]
        todo = np.flatnonzero(pos < end)
        pos = pos[todo]
        while len(todo):
            same = self.head[pos] == h[todo]
            at[todo[same]] = pos[same]
            todo, pos = todo[~same], pos[~same] + 1
            left = pos < end[todo]
            todo, pos = todo[left], pos[left]
        return at, np.where(at >= 0, self.head_counts[at], -1)

    def items(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Item of each token: the word, or its group."""
        at, _ = self.place(h)
        item = np.where(at >= 0, self.item[at], -1) if len(self.head) else at
        return np.where(item >= 0, item, len(self.core) + group)

    def start(self, pairs: np.ndarray) -> None:
        """Classes of the items, from the counts of ordered pairs of items. A word that isn't an item has its group's."""
        cls, self.counts = exchange(pairs, CLASSES, PASSES)
        self.k = len(self.counts)
        self.group_class = cls[len(self.core) :]
        self.word_class = np.full(len(self.head), -1, np.int16)
        self.word_class[self.core] = cls[: len(self.core)]
        self.item = None

    def classes(self, h: np.ndarray, group: np.ndarray, far: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head, count, class of each token, and whether the word itself has that class; far: hashes, in order,
        and classes of the far words among them."""
        at, c = self.place(h)
        own = np.where(at >= 0, self.word_class[at], -1) if len(self.head) else at
        if far is not None and len(far[0]):
            k = np.minimum(np.searchsorted(far[0], h), len(far[0]) - 1)
            own = np.where((at < 0) & (far[0][k] == h), far[1][k], own)
        return at, c, np.where(own >= 0, own, self.group_class[group]), own >= 0

    def best(self, group: int, right: np.ndarray, left: np.ndarray) -> int:
        """The class an exchange step puts a word of a group into, by its pairs to and from the classes of the items."""
        old, counts = self.group_class[group], self.counts.copy()
        counts[old] -= right
        counts[:, old] -= left
        gain = _gain(np.maximum(counts, 0), right, left, 0.0)
        new = int(np.argmax(gain[: self.k - 1]))
        return int(old) if gain[new] <= gain[old] + 1e-9 else new

    def learn(self, counts: np.ndarray) -> None:
        """Probabilities from the counts of ordered pairs of classes, with all words in their classes."""
        own = np.flatnonzero(self.word_class >= 0)
        np.subtract.at(self.group_n, self.head_group[own], self.head_counts[own])
        np.subtract.at(self.group_v, self.head_group[own], 1)
        if self.far:
            self.group_n -= self.far["n"]
            self.group_v -= self.far["v"]
        size = np.bincount(self.word_class[own], weights=self.head_counts[own], minlength=self.k) + np.bincount(self.group_class, weights=self.group_n, minlength=self.k)
        members = np.bincount(self.word_class[own], minlength=self.k) + np.bincount(self.group_class, minlength=self.k)
        if self.far:
            size, members = size + self.far["class_n"], members + self.far["class_v"]
        prior = (size + 1) / (size.sum() + self.k)
        self.move = np.log10((counts + self.k * prior[None, :]) / (counts.sum(axis=1, keepdims=True) + self.k))
        z = np.log10(size + DELTA * members)
        self.z = z
        self.group_emit = np.log10(self.group_n + DELTA) - z[self.group_class]
        self.group_z = np.log10(self.group_n + DELTA * (self.group_v + 1))
        self.group_z[TAILS] = 0


def _train(id_col: str):
    return ~F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def _pairs(items: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous item of each token (the end before the first), and the item."""
    prev = np.empty_like(items)
    prev[1:] = items[:-1]
    prev[np.cumsum(per) - per] = end
    return prev, items


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(id_key("doc_id").alias("did"), "data", F.xxhash64("data").alias("th"), "doc_id")


def _with_far(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The rows of `_keyed`; if there are far words with those of each, by hash and class, as far_h and far_c (null: none)."""
    if not model.far:
        return docs

    def words(batches):
        for whole in batches:
            for b in _batches(whole):
                h, _, per = tokens(b.column(1).to_pylist())
                some = model.place(h)[0] < 0
                owner = np.repeat(np.arange(len(per)), per)[some]
                pairs = np.unique(np.stack((owner.astype(np.uint64), h[some])), axis=1)
                row = pairs[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(k).to_numpy()[row]) for k in (0, 2)] + [pa.array(pairs[1].view(np.int64))], ["did", "th", "h"])

    found = docs.select("did", "data", "th").mapInArrow(releasing(words), "did long, th long, h long").distinct()
    found = found.join(counts.filter("cls is not null").select("h", "cls"), "h").groupBy("did", "th").agg(F.collect_list(F.struct("h", "cls")).alias("far"))
    return docs.join(found, ["did", "th"], "left").select("did", "data", "th", "doc_id", F.col("far.h").alias("far_h"), F.col("far.cls").alias("far_c"))


def _far(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray] | None:
    """The far words of all rows of a batch, by hash, and their classes."""
    if b.num_columns < 6:
        return None
    h, c = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (4, 5))
    h, first = np.unique(h.view(np.uint64), return_index=True)
    return h, c[first]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all training texts, and the counts (h, n) of all words, with the class (cls) of the far ones."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, g[first], np.bincount(inv, weights=n).astype(np.int64)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int16)), pa.array(x[2])], ["h", "g", "n"])

        for whole in batches:
            for b in _batches(whole):
                h, g, _ = tokens(b.column(1).to_pylist())
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, g[first].astype(np.uint8), n.astype(np.int32)))
                size += len(u)
                if size > 1 << 20:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged())

    rows = _keyed(docs.filter(_train("doc_id")))
    counts = cut(rows.mapInArrow(releasing(count), "h long, g short, n long").groupBy("h").agg(F.first("g").alias("g"), F.sum("n").alias("n")))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    bin_ = F.floor(F.log2("n") * BINS)
    above, held = -1, 0  # the head is the words in the upper bins of counts, as many bins as HEAD holds
    for r in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["bin"]):
        held += r["v"]
        if held > HEAD:
            above = r["bin"]
            break
    found = counts.filter(bin_ > above).select("h", "n", "g").toArrow()
    head = (found["h"].to_numpy().view(np.uint64), found["n"].to_numpy(), found["g"].to_numpy().astype(np.int64))
    group_n, group_v = np.zeros(TAILS + 1), np.zeros(TAILS + 1)
    for r in groups:
        group_n[r["g"]], group_v[r["g"]] = r["n"], r["v"]
    model = Model(head, int(group_n.sum()), int(group_v.sum()), (group_n, group_v))

    def sums(cells, rows=rows):
        """Counts of what `cells` gives for the hashes and groups of all tokens, the number of each text and the batch."""

        def run(batches):
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for whole in batches:
                for b in _batches(whole):
                    u, c = np.unique(cells(*tokens(b.column(1).to_pylist()), b), return_counts=True)
                    keys, inv = np.unique(np.concatenate((keys, u)), return_inverse=True)
                    n = np.bincount(inv, weights=np.concatenate((n, c))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

        return rows.mapInArrow(releasing(run), "key long, n long")

    def collected(cells, size: int, rows=rows) -> np.ndarray:
        """The sums as a square matrix; at most size squared, whatever the corpus."""
        got = sums(cells, rows).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size * size)
        out[got["key"].to_numpy()] = got["n"].to_numpy()
        return out.reshape(size, size)

    def of_items(h, g, per, _):
        prev, item = _pairs(model.items(h, g), per, model.n_items - 1)
        return prev * model.n_items + item

    model.start(collected(of_items, model.n_items))
    k = model.k

    def contexts(h, g, per, _):
        """The classes before (first k) and after (next k) each word to place."""
        at, n, cls, own = model.classes(h, g)
        open_ = ~own & (n >= LEAST) & (h != END)
        prev, cls = _pairs(cls, per, k - 1)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        starts = np.cumsum(per) - per
        before[starts] = -1
        out = np.zeros(len(at), bool)
        out[1:] = open_[:-1]
        out[starts] = False
        return np.concatenate((at[open_] * (2 * k) + prev[open_], before[out] * (2 * k) + k + cls[out]))

    def placed(batches):
        """Sums of a word's rows are in one task: its words by 2 k numbers, whatever the corpus."""
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, n = (np.concatenate(x) for x in zip(*got, strict=True))
        words, at = np.unique(key // (2 * k), return_inverse=True)
        total = np.zeros(len(words) * 2 * k, np.int64)
        np.add.at(total, at * (2 * k) + key % (2 * k), n)
        total = total.reshape(len(words), 2, k).astype(float)
        cls = [model.best(model.head_group[w], right, left) for w, (left, right) in zip(words, total, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(cls, pa.int64())], ["word", "class"])

    beyond = counts.filter((bin_ <= above) & (F.col("n") >= LEAST))
    far = above >= 0 and not beyond.isEmpty()
    if far:  # before words of the head have classes, as those are placed without them too
        counts = _place_far(rows, counts, beyond, model)
    if len(model.rest):
        word = F.floor(F.col("key") / F.lit(2 * k))
        found = sums(contexts).repartition(word).mapInArrow(releasing(placed), "word long, class long").toArrow()  # at most HEAD rows
        model.word_class[found["word"].to_numpy()] = found["class"].to_numpy()

    def of_classes(h, g, per, b):
        prev, cls = _pairs(model.classes(h, g, _far(b))[2], per, k - 1)
        return prev * k + cls

    model.learn(collected(of_classes, k, _with_far(rows, counts, model)))
    return model, counts.select("h", "n", F.col("cls") if far else F.lit(None).cast("long").alias("cls"))


def _place_far(rows: DataFrame, counts: DataFrame, beyond: DataFrame, model: Model) -> DataFrame:
    """The counts with a class (cls) for the words of `beyond`, each placed as those of the head are, by its own sums, which
    are one bounded row. The sums of these words by group and by class go into the model."""
    k = model.k

    def contexts(batches):
        """The classes before (first k) and after (next k) each word that isn't in the head."""
        for whole in batches:
            for b in _batches(whole):
                h, g, per = tokens(b.column(1).to_pylist())
                at, _, cls, _ = model.classes(h, g)
                prev, cls = _pairs(cls, per, k - 1)
                some = at < 0
                after = np.zeros(len(h), bool)
                after[1:] = some[:-1]
                after[np.cumsum(per) - per] = False
                of = np.flatnonzero(after)
                x, c = np.concatenate((h[some], h[of - 1])), np.concatenate((prev[some], k + cls[of]))
                order = np.lexsort((c, x))
                x, c = x[order], c[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (c[1:] != c[:-1]))))
                n = np.diff(np.append(first, len(x))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(c[first].astype(np.int64)), pa.array(n)], ["h", "c", "m"])

    def placed(batches):
        for b in batches:
            cls = []
            for g, cells in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total = np.zeros(2 * k)
                for x in cells:
                    total[x["c"]] = x["m"]
                cls.append(model.best(g, total[k:], total[:k]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64())], ["h", "cls"])

    near = rows.mapInArrow(releasing(contexts), "h long, c long, m long").join(beyond.select("h", "g"), "h")
    near = near.groupBy("h", "g", "c").agg(F.sum("m").alias("m")).groupBy("h", "g").agg(F.collect_list(F.struct("c", "m")).alias("cells"))
    out = cut(counts.join(near.mapInArrow(releasing(placed), "h long, cls long"), "h", "left"))
    far = out.filter("cls is not null")
    model.far = {"n": np.zeros(TAILS + 1), "v": np.zeros(TAILS + 1), "class_n": np.zeros(k), "class_v": np.zeros(k)}
    for key, n, v in (("g", "n", "v"), ("cls", "class_n", "class_v")):
        for r in far.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            model.far[n][r[key]], model.far[v][r[key]] = r["n"], r["v"]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end token alone. Rows without an id are learned from. Repeated rows are counted each, and
    get equal scores. A word's probability is that of its class after the class before, times its own within the class.
    The ITEMS most frequent words and the groups of rare words are exchanged together; every other word
    that occurs LEAST times or more then takes one exchange step by its own counts, distributed; the HEAD most frequent are
    looked up in each task, those beyond by joins, with the same result. A rarer word shares its
    group's part by its count plus DELTA, as does one never seen. Other columns are left out; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    small_batches(docs.sparkSession)
    settle(docs.sparkSession)  # workers that hold the head need room beside the heaps
    model, counts = train(docs)
    settle(docs.sparkSession)
    keyed = _keyed(docs)

    def heads(batches):
        m = model
        z = np.log10(m.n + DELTA * (m.v + 1))
        for whole in batches:
            for b in _batches(whole):
                h, g, per = tokens(b.column(1).to_pylist())
                _, c, cls, placed = m.classes(h, g, _far(b))
                prev, cls = _pairs(cls, per, m.k - 1)
                own = np.log10(np.maximum(c, 0) + DELTA) * (c >= 0)
                emit = m.group_emit[g] + np.where(g < TAILS, own, 0) - m.group_z[g]
                emit = np.where(placed, own - m.z[cls], emit)  # a far word's count is joined
                value = m.move[prev, cls] + emit
                edges = np.cumsum(per) - per
                add = lambda x: pa.array(np.add.reduceat(x, edges))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), b.column(3), pa.array(per.astype(np.int64)), add((c > 0).astype(np.int64)), add(own - z), add(value)],
                    ["did", "th", "doc_id", "n_tokens", "n_known", "base", "value"],
                )

    def tails(batches):
        m = model
        for whole in batches:
            for b in _batches(whole):
                h, g, per = tokens(b.column(1).to_pylist())
                _, c = m.place(h)
                at = np.flatnonzero(c < 0)
                owner = np.repeat(np.arange(len(per)), per)[at]
                order = np.lexsort((h[at], owner))
                hs, os = h[at][order], owner[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(hs)), bool), (hs[1:] != hs[:-1]) | (os[1:] != os[:-1]))))
                tf = np.diff(np.append(first, len(hs)))
                did, th = b.column(0).to_numpy(), b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(hs[first].view(np.int64)), pa.array(did[os[first]]), pa.array(th[os[first]]), pa.array(tf.astype(np.int32))], ["h", "did", "th", "tf"])

    whole = keyed.select("did", "data", "th", "doc_id")
    head = _with_far(whole, counts, model).mapInArrow(releasing(heads), "did long, th long, doc_id long, n_tokens long, n_known long, base double, value double")
    tail = whole.mapInArrow(releasing(tails), "h long, did long, th long, tf int").join(counts.select("h", "n"), "h", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.groupBy("did", "th").agg(F.sum(F.col("tf") * F.log10(n + DELTA)).alias("t"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("k"))
    copies = whole.groupBy("did", "th").agg(F.count("*").alias("copies"))
    sums = copies.join(tail, ["did", "th"], "left")
    t = F.coalesce(F.col("t"), F.lit(0.0)) / F.col("copies")
    k = F.coalesce(F.col("k") / F.col("copies"), F.lit(0)).cast("long")
    return head.join(sums, ["did", "th"]).select(
        "doc_id", (~_train("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + k).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + t).alias("base_score"), (F.col("value") + t).alias("score"),
    )


def op6_brown(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
