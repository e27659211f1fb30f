"""N-gram Jaccard join: documents with identical prefixes and size form a group, group pairs are filtered, members verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _batches
from .common import NULL_ID, cut, grams, hash_words, id_key, mix, releasing
from .components import components

WIDTH, NUM, DEN = 3, 90, 100  #: words in a shingle; two sets link when DEN * intersection >= NUM * union
COMMON = 16_384  #: shingles known as frequent, which come last in the order of prefixes
MARKS = (128, 1 << 17)  #: fewest and most parity marks of a set; between them, the power of two above 4 times the bits that may differ
BLOCK = 1024  #: entries of a list met at once; a larger list is met block by block
EDGES = 1 << 21  #: pairs held before they are thinned out to a forest
BROADCAST = 1_000_000  #: ids sent to every task at most
_SET = "did long, cid long, sid long, n int"
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit hashes; a text with fewer words than a shingle is one shingle of them all."""
    words, per = hash_words(texts, lower=True)
    ends = np.cumsum(per)
    at = np.arange(len(words))
    whole = at + width <= np.repeat(ends, per)
    h = grams(words, width)[whole]
    owner = np.repeat(np.arange(len(per)), per)[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    h, owner = h[new], owner[new]
    sets = np.split(h, np.searchsorted(owner, np.arange(1, len(per)))) if len(per) else []
    for i in np.flatnonzero((per > 0) & (per < width)):
        own = words[ends[i] - per[i] : ends[i]]
        sets[i] = grams(own, int(per[i]))[:1] ^ np.uint64(per[i])
    return sets


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]), int(mix(s ^ _SALT).sum(keepdims=True).view(np.int64)[0])


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_key(id_col).alias("did"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Frequent shingles, the most frequent last: those in a thousandth of the documents of some task, counted over all.

    They only order prefixes; whichever they are, no pair is lost.
    """

    def run(batches):
        held: list[np.ndarray] = []
        docs = size = 0

        def out():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3, docs // 1000)
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often])], ["t", "n"])

        for whole in batches:
            for b in _batches(whole):
                sets = shingles(b.column(1).to_pylist(), width)
                held += sets
                docs += len(sets)
                size += sum(map(len, sets))
                if size > 1 << 21:
                    yield out()
                    held, docs, size = [], 0, 0
        if held:
            yield out()

    top = rows.mapInArrow(releasing(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(COMMON).collect()
    return np.array([r["t"] for r in reversed(top)], np.int64).view(np.uint64)


def _described(rows: DataFrame, frequent: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """Per document the names and size of its set, the name of its group, prefix and parity marks."""
    by = np.argsort(frequent)
    known, rank = frequent[by], by.astype(np.uint64)

    def prefix(s: np.ndarray) -> np.ndarray:
        p = len(s) - -(-num * len(s) // den) + 1
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            common = known[at] == s
            if common.any():
                return np.concatenate((s[~common], s[common][np.argsort(rank[at[common]])]))[:p]
        return s[:p]

    def run(batches):
        for whole in batches:
            for b in _batches(whole):
                sets = shingles(b.column(1).to_pylist(), width)
                names = [_names(s) for s in sets]
                heads = [prefix(s) if len(s) else s for s in sets]
                groups = [_names(np.concatenate((h, np.array([len(s)], np.uint64))))[0] for h, s in zip(heads, sets, strict=True)]
                marks = []
                for s in sets:
                    width_ = min(max(MARKS[0], 1 << (8 * len(s) * (den - num) // (den + num)).bit_length()), MARKS[1])
                    bits = (np.bincount((mix(s + _SALT) & np.uint64(width_ - 1)).astype(np.int64), minlength=width_) & 1).astype(np.uint8)
                    marks.append(np.packbits(bits).tobytes())
                lens = np.array([len(h) for h in heads], np.int64)
                flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(flat)), pa.array(marks, pa.binary()),
                    ],
                    ["did", "cid", "sid", "n", "gid", "prefix", "marks"],
                )

    return rows.mapInArrow(releasing(run), f"{_SET}, gid long, prefix array<long>, marks binary")


def _bits(marks: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many parity marks the sets of each pair differ; the longer marks of the two are folded onto the shorter."""
    out = np.zeros(len(i), np.int64)
    code = wide[i] << 32 | wide[j]
    for c in np.unique(code):
        at = np.flatnonzero(code == c)
        low = min(int(c) >> 32, int(c) & 0xFFFFFFFF) // 8
        step = max(1, (1 << 21) // low)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a, b = (np.bitwise_xor.reduce(np.frombuffer(b"".join(marks[y[part]]), np.uint64).reshape(len(part), -1, low), axis=1) for y in (i, j))
            out[part] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


def _meeting(posts: DataFrame, num: int, den: int) -> DataFrame:
    """The posts, dealt out by token, that some other post of their token, or another member of their group, may link with.

    In order of size within a token, that is the next post for an early one, and for any the last early one before it, if
    it is near in size; only two rows are kept in mind.
    """
    names = ["token", "gid", "n", "members", "lead", "early"]

    def out(x, go):
        return pa.RecordBatch.from_arrays([pa.array(x[c][go]) for c in names], names)

    def run(batches):
        last = before = None  # the row before a batch, and token and size of the last early one before that
        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            x["lead"], x["early"] = x["lead"].astype(bool), x["early"].astype(bool)
            x["go"] = x["lead"] & (x["members"] > 1)
            if last is not None:
                x = {c: np.concatenate((last[c], x[c])) for c in x}
            n, token, early = x["n"].astype(np.int64), x["token"], x["early"]
            x["go"][:-1] |= early[:-1] & (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
            at = np.maximum.accumulate(np.where(early, np.arange(len(n)), -1))
            at = np.concatenate(([-1], at[:-1]))
            x["go"] |= (at >= 0) & (token[at] == token) & (den * n[at] >= num * n)
            if before is not None:
                x["go"] |= (at < 0) & (token == before[0]) & (den * before[1] >= num * n)
            if early[:-1].any():
                k = np.flatnonzero(early[:-1])[-1]
                before = token[k], n[k]
            last = {c: v[-1:].copy() for c, v in x.items()}
            x["go"][-1] = False
            yield out(x, x["go"])
        if last is not None:
            yield out(last, last["go"])

    return posts.select(*names).sortWithinPartitions("token", "n").mapInArrow(releasing(run), "token long, gid long, n int, members long, lead boolean, early boolean")


def _forest(i: np.ndarray, j: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j), in order of weight, make the least spanning forest over the parts that nodes are in."""
    n, part, chosen, live = len(part), part.copy(), [np.zeros(0, np.int64)], np.arange(len(i))
    while True:
        x, y = part[i[live]], part[j[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.sort(np.concatenate(chosen))
        best = np.full(n, len(i))
        for side in (x, y):
            own = np.full(n, len(i))
            own[side[::-1]] = live[::-1]  # of equal places the last one written stays: the lightest edge
            best = np.minimum(best, own)
        pick = np.unique(best[best < len(i)])
        chosen.append(pick)
        x, y, label = part[i[pick]], part[j[pick]], np.arange(n)
        while True:
            low, new = np.minimum(label[x], label[y]), label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        part = label[part]


def _pairs(num: int, den: int, all_: bool):
    """Pairs of classes in the same list, not yet in one component, that sizes and marks allow: a spanning forest of each list,
    of the pairs with the fewest differing marks, or all; and whether the list has more than those.

    Members of two groups meet if their sizes do and the list is early for the smaller set, as that of their first common
    shingle is if they link; members of one group meet in the list of its first prefix shingle. The
    parity marks of two sets differ in at most as many bits as the sets differ in shingles.
    """
    names = ["token", "lo", "hi", "own", "gid", "cid", "n", "lead", "early", "root"]

    def test(i, j, x):
        n = x["n"]
        ok = (x["cid"][i] != x["cid"][j]) & (x["root"][i] != x["root"][j])
        ok &= ((x["gid"][i] != x["gid"][j]) | x["lead"][i]) & x["early"][i]
        ok &= (x["lo"][i] == x["hi"][i]) | (x["own"][i] != x["own"][j])
        i, j = i[ok], j[ok]
        differ = _bits(x["marks"], x["wide"], i, j)
        fits = differ * (den + num) <= (n[i] + n[j]) * (den - num)
        return np.stack([i[fits], j[fits], differ[fits] * 1024 // (n[i[fits]] + n[j[fits]])])

    def thin(edges, x, part):
        """The forest of edges, in an order that all lists with the same members share."""
        a, b = (f(x["cid"][edges[0]], x["cid"][edges[1]]) for f in (np.minimum, np.maximum))
        edges = edges[:, np.lexsort((b, a, edges[2]))]
        return edges[:, _forest(edges[0], edges[1], part)]

    def out(edges, x, more):
        i, j = edges[0], edges[1]
        a, b = (f(x["cid"][i], x["cid"][j]) for f in (np.minimum, np.maximum))
        return pa.RecordBatch.from_arrays([pa.array(x["token"][i]), pa.array(a), pa.array(b), pa.array(more)], ["token", "a", "b", "more"])

    def lists(x):
        """Whole lists, sorted by key and size: each entry meets the next, the one after it, and so on while sizes allow."""
        m = len(x["n"])
        new = np.concatenate(([True], (x["token"][1:] != x["token"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])))
        run = np.cumsum(new) - 1
        part = np.unique(np.stack([run, x["root"]]), axis=1, return_inverse=True)[1].ravel()
        # nodes are the parts, so that the forest spans components
        live, edges, many, d = np.arange(m), np.zeros((3, 0), np.int64), np.zeros(run[-1] + 1, np.int64), 0
        while len(live):
            d += 1
            live = live[live + d < m]
            live = live[(run[live] == run[live + d]) & (den * x["n"][live] >= num * x["n"][live + d])]
            found = test(live, live + d, x)
            many += np.bincount(run[found[0]], minlength=len(many))
            edges = np.concatenate((edges, found), axis=1)
            if edges.shape[1] > EDGES:
                if all_:
                    yield out(edges, x, np.zeros(edges.shape[1], bool))
                edges = edges[:, :0] if all_ else thin(edges, x, part)
        if edges.shape[1]:
            edges = edges if all_ else thin(edges, x, part)
            kept = np.bincount(run[edges[0]], minlength=len(many))
            yield out(edges, x, (many > kept)[run[edges[0]]] & (not all_))

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            # at first each class is a component of its own
            x = {c: b.column(c if c in b.schema.names else "cid").to_numpy(zero_copy_only=False) for c in names}
            x["lead"], x["early"], x["n"] = x["lead"].astype(bool), x["early"].astype(bool), x["n"].astype(np.int64)
            x["marks"] = np.empty(b.num_rows, object)
            x["marks"][:] = b.column("marks").to_pylist()
            x["wide"] = np.array([len(y) for y in x["marks"]], np.int64)
            if held is not None:
                x = {c: np.concatenate((held[c], x[c])) for c in x}
            k = len(x["n"]) - 1
            last = np.flatnonzero((x["token"] == x["token"][k]) & (x["lo"] == x["lo"][k]) & (x["hi"] == x["hi"][k]))[0]
            if last:
                yield from lists({c: v[:last] for c, v in x.items()})
            held = {c: v[last:] for c, v in x.items()}
        if held is not None:
            yield from lists(held)

    return run


def _verified(rows: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, compared whole."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct().join(reps, "cid")
    needed = cut(needed.select("cid", "did"))
    wanted = needed.select("did").distinct()
    if needed.count() <= BROADCAST:
        wanted = F.broadcast(wanted)

    def run(batches):
        for whole in batches:
            for b in _batches(whole):
                sets = shingles(b.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array([_names(s)[0] for s in sets], pa.int64()), b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "did", "data"])

    sets = rows.join(wanted, "did", "left_semi").mapInArrow(releasing(run), "cid long, did long, data binary").join(needed, ["cid", "did"], "left_semi")
    sets = sets.groupBy("cid").agg(F.first("data").alias("data"))
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("data").alias("y")), "b")

    def compare(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(releasing(compare), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    A set is the distinct shingles of `width` words, A-Z in lower case; sets link when den * intersection >= num * union.
    Equal sets are one class; classes with the same prefix and size are one group; a prefix shingle lists the groups
    that have it. A list beyond BLOCK entries is met block by block, in tasks of their own. Of each block a spanning
    forest of the pairs that may link is verified on whole sets, then one over the components so found and all blocks,
    then every pair that is left between components. A list is met again only if its forest has ends in two components.

    A null or empty text, or one without words, has no shingles and is its own component, as is a row without an id,
    whose component is null unless it links with others. Rows that share id and text are one class. Other columns are
    left out; an empty table gives no rows.
    """
    rows = _docs(docs, id_col, text_col)
    sets = cut(_described(rows, _frequent(rows, width), width, num, den))
    classes = sets.filter("n > 0").groupBy("cid", "sid", "n").agg(F.min("did").alias("did"), F.first("gid").alias("gid"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
    classes = cut(classes)
    reps = classes.select("cid", "did")
    posts = classes.select("gid", "n", F.posexplode("prefix").alias("at", "token"))
    # sets of n and m >= n shingles that link share 2 * num * n / (num + den) at least, from their first common one on
    early = F.expr(f"at <= n - (2L * {num} * n + {num + den - 1}) div {num + den}")
    posts = posts.select("token", "gid", "n", (F.col("at") == 0).alias("lead"), early.alias("early"))
    # the members of a group are counted where its posts go anyway, so prefixes aren't shuffled another time
    posts = posts.repartition("token").groupBy("token", "gid", "n", "lead", "early").agg(F.count("*").alias("members"))
    posts = cut(_meeting(posts, num, den))
    counts = posts.groupBy("token").agg(F.sum("members").alias("entries"))
    posts = posts.join(counts, "token").drop("members")

    posts = posts.withColumn("blocks", F.ceil(F.col("entries") / BLOCK).cast("int"))

    def listed(posts: DataFrame, across: bool) -> DataFrame:
        """A row for each list, block pair (or block) and class."""
        rows = posts.join(classes.select("gid", "cid", "marks"), "gid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("own"))
        return rows.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "gid", "cid", "n", "lead", "early", "marks")

    def tried(lists: DataFrame, all_: bool) -> DataFrame:
        order = ["token", "lo", "hi"]
        return lists.repartition(*order).sortWithinPartitions(*order, "n").mapInArrow(_pairs(num, den, all_), "token long, a long, b long, more boolean")

    made = cut(tried(listed(posts, False), False))
    seen = cut(made.select("a", "b").distinct())
    links = cut(_verified(rows, seen, reps, width, num, den))
    def unjoined(made: DataFrame, roots: DataFrame) -> DataFrame:
        """Tokens of the lists that have more pairs than the forest tried, some of whose ends are in two components still.

        A forest spans all pairs of its list, so that once its own pairs are joined every pair of the list is.
        """
        a, b = roots.toDF("a", "x"), roots.toDF("b", "y")
        tried_ = made.filter("more").join(a, "a", "left").join(b, "b", "left")
        return tried_.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("token")

    roots = components(links).toDF("cid", "root")
    tokens = cut(unjoined(made, roots).union(posts.filter("blocks > 1").select("token")).distinct())
    for all_ in (False, True):
        if tokens.isEmpty():
            break
        open_ = cut(posts.join(tokens, "token", "left_semi"))
        # few lists are left, and then the classes stay where they are
        open_ = F.broadcast(open_) if open_.count() <= BROADCAST else open_
        again = listed(open_, True).join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        made = cut(tried(again, all_))
        pairs = cut(made.select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"))
        links, seen = links.union(cut(_verified(rows, pairs, reps, width, num, den))), seen.union(pairs)
        roots = components(links).toDF("cid", "root")
        tokens = cut(unjoined(made, roots).distinct())
    named = reps.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("did").alias("least"))
    named = named.join(least, "root").select("cid", "least")
    out = sets.filter("n > 0").select("did", "n", "cid").join(named, "cid").select("did", "n", "least")
    out = out.union(sets.filter("n = 0").select("did", "n", F.col("did").alias("least")))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("did").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known("least").alias("component_id"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
