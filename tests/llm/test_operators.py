"""Each operator against brute force on small tables, and the defined results of odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import ann, bpe, brown, common, components, jaccard, langid, lines, media, packing, secrets, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, n int, n_words int, r int, did int, row int"
DOG = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals near by today again and again"


def frame(spark, texts, ids=None):
    """Documents with other columns whose names operators use themselves."""
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   ", "one", DOG, DOG, DOG + " x", "é" * 5000, "word " * 3000, DOG.upper(), DOG]
    return frame(spark, texts, [1, 2, 3, 4, 5, 6, 7, 8, 9, None, 5])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_substring(spark, odd, empty):
    out = substring.substring_dedup(odd).collect()
    assert len(out) == 11
    docs = sorted(((r["doc_id"] if r["doc_id"] is not None else 2**63, r["text"]) for r in odd.collect()), key=lambda x: x[0])
    first = {}
    for i, t in docs:
        for p in range(len(w := WORD.findall(t or "")) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (i, p)), (i, p))
    want = Counter()
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (i, p) for q in range(p, p + 20)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        want[(i if i < 2**63 else None, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == want
    assert substring.substring_dedup(empty).count() == 0
    assert {r["longest"] for r in substring.longest_repeats(odd).filter("doc_id = 9").collect()} == {2560}


def test_jaccard(spark, odd, empty):
    texts = [" ".join(f"w{(k * 7 + j) % 900}" for j in range(60 + k % 3)) for k in range(40)] + [DOG, DOG + " end", "a b", "a b", None, ""]
    docs = frame(spark, texts)
    sets = [frozenset(tuple(w[p : p + 3]) for p in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []) for w in (WORD.findall(lower(t)) for t in texts)]
    root = list(range(len(texts)))
    for _ in root:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i + 1: (len(x), root[i] + 1) for i, x in enumerate(sets)}
    assert jaccard.jaccard_components(odd).count() == 11 and jaccard.jaccard_components(empty).count() == 0


def test_forest():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        i, j = rng.integers(0, n, (2, 3 * n))
        part = np.arange(n)
        want, root = [], list(range(n))
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if root[x] != root[y]:
                want.append(k)
                root = [root[x] if r == root[y] else r for r in root]
        assert jaccard._forest(i, j, part).tolist() == want


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_of_a_large_group(spark, monkeypatch, block):
    """Near copies about the threshold, in whole lists and in lists cut into blocks, by brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(block)
    texts = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(90)]
        for _ in range(60):
            t = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 4)):
                t[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(t))
    sets = [{tuple(w[p : p + 3]) for p in range(len(w) - 2)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(x & sets[j]) >= 90 * len(x | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == {i + 1: r + 1 for i, r in enumerate(root)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_on_the_driver(spark, monkeypatch):
    """Few edges are joined without shuffles, with the result of the steps."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, 60)], rng.integers(0, 60, 60), strict=True)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = components.components(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(components, "LOCAL", -1)
    assert sorted(found.collect()) == sorted(components.components(df).collect()) and found.schema == components.components(df).schema


def test_langid(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "of", "and", "thing", "was"], "de": ["der", "und", "nicht", "schon", "zu"]}
    docs = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    train = df.filter(~langid.held_out())
    out = langid.identify(df, langid.sample(train)).filter(langid.held_out()).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert out and all(r["lang"] == r["lang_pred"] and 0 < r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd.filter("doc_id < 4"), langid.sample(train), keep=True).collect()}
    assert got == {1: "und", 2: "und", 3: "und"}
    assert langid.identify(empty, langid.sample(empty)).count() == 0
    # a phrase is a longest match in the sample, or a character that it lacks
    m = langid.model((("x", "abcabd"), ("y", "zzzz")))
    assert np.rint(m.phrases(["abcabdabc"])[0] / np.array(m.bits)).tolist() == [2, 9]


def test_phrases(monkeypatch):
    """Against a naive parse, with texts longer than a segment."""
    monkeypatch.setattr(langid, "SEGMENT", 16)
    rng = np.random.default_rng(4)
    sample = "".join(rng.choice(list("abcd"), 300))
    m = langid.Model((("x", sample), ("y", "éclair")))
    texts = ["abqcd", "qqqq", "a", *("".join(rng.choice(list("abcdqz"), n, p=[0.24, 0.24, 0.24, 0.24, 0.02, 0.02])) for n in (15, 16, 17, 100, 500))]

    def naive(t, sample):
        n = at = 0
        while at < len(t):
            to = at + 1
            while to < len(t) and t[at : to + 1] in sample:
                to += 1
            at, n = to, n + 1
        return n

    got = m.phrases(texts) / np.array(m.bits)
    assert np.rint(got).astype(int).tolist() == [[naive(t, sample), naive(t, "éclair")] for t in texts]


def test_held_out_accuracy(spark):
    found = langid.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out and lang is not null and lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98, right


def test_names_with_dots(spark):
    import corpus_pipeline as p

    df = spark.createDataFrame([(1, "the text of a.b", "en", 1)], "doc_id long, text string, lang string, `a.b` int")
    for stage in (p.lines, p.near_copies, p.secrets):
        assert stage(spark, df, "").collect() == df.collect()


@pytest.mark.parametrize("name", ["op1_substring", "op2_jaccard"])
def test_oracles(spark, name):
    import duckdb

    from lacuna.llm import registry

    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    out = registry.QUERIES[name](spark, d)
    want = c.sql(registry.ORACLES[name])
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_media(odd, empty):
    for r in media.media_features(media.to_media(odd)).join(odd.select("doc_id", "text"), "doc_id").collect():
        data = (r["text"] or "").encode()
        pad = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        starts, ends, tensors = media.load_segments(r["segments"])
        assert tensors.shape == (len(starts), media.BINS, media.MELS) and (ends > starts).all()
        want = media.features(pad)[1]
        assert starts.tolist() == [x[0] for x in want] and all((t == x[2]).all() for t, x in zip(tensors, want, strict=True))
    assert media.to_media(empty).count() == 0
    t = media.tensor_array([np.zeros((media.BINS, media.MELS), np.float32)] * 3)
    assert t.type.shape == [media.BINS, media.MELS] and len(t) == 3
    assert media.load(media.store(b"\x00\x01")) == b"\x00\x01" + b"\xff" * 574
    tone = np.concatenate((np.zeros(4000), np.sin(np.arange(4000)), np.zeros(4000)))
    assert len(media.segments(media.log_mel(media.resample(tone)).mean(axis=1))) == 1


def test_bpe(odd, empty):
    import public_tokenizers as P
    import tiktoken

    table = bpe.ranks(*bpe.vocabulary("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.rank, special_tokens={})
    for r in bpe.decode(bpe.encode(odd)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["data"]) == (r["text"] or "").encode()
    assert bpe.digest(empty).count() == 0
    text = "It's 123 don't!!  \n\n\tx\x1c\x85 y" + "ab" * 5000
    assert table.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_packing(spark, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    rows = packing.pack_documents(docs).collect()
    for d in docs.collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert sum(v != 4096 for v in by.values()) <= 1 and packing.pack_documents(empty).count() == 0


def test_packing_of_many_partitions(spark):
    """Padding doesn't depend on how many partitions hold the documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64, "doc_id")
    r = packing.pack_documents(docs).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert r[0] / (r[1] * packing.WINDOW) >= 0.98


def test_packing_neighbours():
    """Every document that shares a term with the seed is a neighbour, in the order of the whole query's BM25."""
    rng = np.random.default_rng(5)
    docs = [np.arange(40, dtype=np.uint16), *(np.array([k, 100 + k], np.uint16) for k in range(40)), np.array([500], np.uint16)]
    docs += [rng.integers(0, 60, 30).astype(np.uint16) for _ in range(20)]
    n, lens = len(docs), np.array([len(d) for d in docs])
    score = np.zeros(n)
    for t in np.unique(docs[0]):
        tf = np.array([(d == t).sum() for d in docs])
        df = (tf > 0).sum()
        score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * lens / lens.mean()))
    got = packing.Index(docs).neighbours(0)
    assert set(got.tolist()) == set(np.flatnonzero(score).tolist()) and (np.diff(score[got]) <= 1e-9).all()


def test_brown(spark, odd, empty):
    texts = [" ".join(x) for x in np.random.default_rng(1).choice(["a", "b", "C", "dd", "e"], (60, 30))] + [None, "", "unseen words"]
    df = frame(spark, texts)
    docs = {i + 1: [*WORD.findall(lower(t)), "\0end"] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    z = np.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for r in brown.score(df).collect():
        ws = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), sum(c.values()))
        assert abs(r["base_score"] - sum(np.log10(c[w] + 0.1) - z for w in ws)) < 1e-9 and r["score"] < 0
    assert brown.score(odd).count() == 11
    assert brown.score(empty).count() == 0
    pairs = np.array([[0, 9, 0, 9, 1], [9, 0, 9, 0, 1], [0, 9, 0, 9, 1], [9, 0, 9, 0, 1], [1, 1, 1, 1, 0]])
    cls, counts = brown.exchange(pairs.astype(float), classes=3)
    one = np.eye(3)[cls]
    assert (counts == one.T @ pairs @ one).all()
    assert cls[0] == cls[2] != cls[1] == cls[3] and cls[4] == 2


def test_brown_placement(spark, monkeypatch):
    """Words outside the core take the class of words used alike, and the model's probabilities add up to 1."""
    monkeypatch.setattr(brown, "ITEMS", 8)
    monkeypatch.setattr(brown, "CLASSES", 4)
    rng = np.random.default_rng(7)
    nouns, verbs = [f"n{k}x" for k in range(40)], [f"v{k}x" for k in range(40)]
    weight = 1 / np.arange(1, 41)
    pick = lambda words: str(rng.choice(words, p=weight / weight.sum()))
    docs = frame(spark, [" ".join(pick(w) for _ in range(20) for w in (nouns, verbs)) for _ in range(400)])
    m, _ = brown.train(docs.select("doc_id", F.encode("text", "UTF-8").alias("data")))
    cls = dict(zip(m.head.tolist(), m.word_class.tolist(), strict=True))
    of = lambda words: [cls[int(h)] for h in brown.tokens([" ".join(words).encode()])[0][:-1]]
    assert len(m.rest) >= 60 and len(set(of(nouns[:4]) + of(verbs[:4]))) >= 2
    n, v = set(of(nouns)) - {-1}, set(of(verbs)) - {-1}
    assert not n & v
    assert np.allclose((10**m.move).sum(axis=1), 1)
    own = m.word_class >= 0
    mass = np.bincount(m.word_class[own], weights=10 ** m.word_emit[own], minlength=m.k) + np.bincount(m.group_class, weights=10**m.group_emit, minlength=m.k)
    assert np.allclose(mass, 1)


def test_brown_beyond_the_head(spark, monkeypatch):
    """Words beyond the head are placed by their own counts as well, so that scores don't depend on what the head holds."""
    monkeypatch.setattr(brown, "ITEMS", 8)
    monkeypatch.setattr(brown, "CLASSES", 6)
    rng = np.random.default_rng(11)
    sides = [[f"{x}{k}{y}" for k, y in enumerate(rng.choice(list("xyz"), 60))] for x in "nv"]
    weight = 1 / np.arange(1, 61)
    texts = [" ".join(str(rng.choice(w, p=weight / weight.sum())) for _ in range(20) for w in sides) for _ in range(150)]
    docs = frame(spark, [*texts, None, "", texts[0], "n3x unseen"], [*range(1, 151), 151, 152, 1, None])
    get = lambda: sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in brown.score(docs).collect())
    want = get()
    monkeypatch.setattr(brown, "HEAD", 30)
    assert np.allclose(get(), want, rtol=1e-12, atol=1e-9)
    m, counts = brown.train(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")))
    assert len(m.head) <= 30 and counts.filter("cls is not null").count() >= 40


def test_lines(spark, odd, empty):
    a, b = "This is a long enough line about foxes and dogs.", "This is a long enough line about foxes and dogs!"
    df = frame(spark, [f"{a}\nshort\n{a}", f"other words stand here instead\n{b}\nshort", None, ""])
    got = {r["did"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (3, 1, f"{a}\nshort"), 2: (3, 1, "other words stand here instead\nshort"), 3: (0, 0, None), 4: (1, 0, "")}
    assert lines.dedup_lines(odd).count() == 11 and lines.dedup_lines(empty).count() == 0
    plan = lines.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _linked(spark, texts):
    """Whether each pair of alike lines is in one component, by brute force over characters."""
    sets = [{t[p : p + 5] for p in range(len(t) - 4)} for t in texts]
    df = frame(spark, texts)
    roots = {r["node"]: r["root"] for r in components.components(lines.alike(lines._lines(df, "doc_id", "text", 1))).collect()}
    ids = {r["line"]: r["lid"] for r in lines._lines(df, "doc_id", "text", 1).collect()}
    ids = [roots.get(ids[t], ids[t]) for t in texts]
    found = [(ids[i] == ids[j]) for i in range(len(texts)) for j in range(i) if 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return found, ids, sets


def test_lines_near_the_threshold(spark):
    """Recall of pairs of 49 to 52 characters that one edit in the middle brings down to the threshold, of any script."""
    rng = np.random.default_rng(8)
    for letters in ("abcdefghijklmnop rst", "абвгдежзийклмноп рст"):
        texts = []
        for k in range(400):
            t = "".join(rng.choice(list(letters), 49 + k % 4)).replace(" ", "_")
            texts += [t, t[:24] + "#" + t[25:]]
        found, _, _ = _linked(spark, texts)
        assert len(found) == 400 and sum(found) >= 0.95 * len(found)


def test_lines_of_real_documents(spark):
    """Recall against brute force on the lines of documents, and no component joined by anything but links."""
    texts = [r["line"] for r in lines._lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text", 1).select("line").distinct().collect()]
    texts = [t for t in texts if len(t) >= 5 and ord(max(t)) < 0x10000]
    found, ids, sets = _linked(spark, texts)
    assert sum(found) >= 0.98 * len(found)
    by = {}
    for i, r in enumerate(ids):
        by.setdefault(r, []).append(i)
    for group in by.values():
        for i in group if len(group) > 1 else []:
            assert any(i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in group)


def test_lines_inside_a_band(spark):
    """Pairs of alike lines in a band with lines unlike them are found."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("bcdfghjklmnp"), n))
    base = [word(60) for _ in range(12)]
    df = frame(spark, [f"{b}\nz{b}" for b in base])
    rows = lines._lines(df, "doc_id", "text", 1)
    texts = rows.select("lid", "line").join(lines._marks(rows.select("lid", "line")), "lid")
    bands = rows.select(F.lit(7).cast("long").alias("band"), "lid")
    none = spark.createDataFrame([], "a long, b long")
    got = lines._verified(lines._others(bands, texts.select("lid", "n", "marks"), none), texts).collect()
    assert len(got) == 12


@pytest.mark.parametrize("whole", [2, 64, 512])
def test_lines_of_large_bands(spark, monkeypatch, whole):
    """All alike pairs that share a band, however large, are in one component: lines around the threshold of a common text."""
    monkeypatch.setattr(lines, "WHOLE", whole)
    rng = np.random.default_rng(9)
    letters = list("bcdfghjklmnp")
    base, texts = "".join(rng.choice(letters, 300)), []
    for k in range(400):
        t = list(base)
        for at in rng.choice(295, 3 + k % 6, replace=False):
            t[at : at + 2] = rng.choice(letters, 2)
        texts.append("".join(t))
    found, ids, sets = _linked(spark, texts)
    rows = lines._lines(frame(spark, texts), "doc_id", "text", 1)
    at = {r["lid"]: r["did"] - 1 for r in rows.collect()}
    bands = {}
    for r in lines._bands(lines._signed(rows)).collect():
        bands.setdefault(r["band"], []).append(at[r["lid"]])
    assert max(map(len, bands.values())) > 64
    met = {(i, j) for b in bands.values() for i in b for j in b if i < j}
    assert all(ids[i] == ids[j] for i, j in met if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert len(set(ids)) > 1 and len(found) > 100


def test_lines_shuffle_little(spark):
    """Of lines that are signed only their least values are shuffled, and pairs that marks tell apart are not compared whole."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("bcdfghjklmnp"), n))
    shared = word(300)
    texts = [shared + word(700) for _ in range(40)]
    rows = lines._lines(frame(spark, texts + [texts[0] + "z"]), "doc_id", "text", 1).repartition(8).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert lines._signed(rows).count() == 41 and written() - before < sum(map(len, texts)) / 10
    marks = lines._marks(rows.select("lid", "line"))
    pairs = rows.select(F.col("lid").alias("a")).join(rows.select(F.col("lid").alias("b")), F.col("a") < F.col("b"))
    assert pairs.count() == 820 and lines._likely(pairs, marks).count() == 1


def test_lines_short(spark, tmp_path):
    """Short lines that repeat go, in the query and in the pipeline's stage; those unlike others and blank ones stay."""
    import corpus_pipeline as p

    texts = ["Les.\nab\n\n", "Les.\n \nAnd ornd.\nother", "ab\nAnd ornd.\nab\n\nabc", "a line of 19 letter\nabcdefghij klmn\n\r", "a line of 19 letters\n\r"]
    kept = ["Les.\nab\n\n", " \nAnd ornd.\nother", "\nabc", "a line of 19 letter\nabcdefghij klmn\n\r", "\r"]
    df = frame(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in lines.op8_lines(spark, str(tmp_path)).collect()}
    assert got == {i + 1: (n, hashlib.sha256(k.encode()).hexdigest()) for i, (n, k) in enumerate(zip([0, 1, 3, 0, 1], kept, strict=True))}
    assert {r["doc_id"]: r["text"] for r in p.lines(spark, df, "").collect()} == dict(enumerate(kept, 1))


def test_secrets(spark, odd, empty):
    token = "Xk9fQ2pLm7Zt4Wb8Nc3Rv6Yd1Hs5Jg0T"
    text = f'é API_KEY = "abc" token:abcdef1 password: token: xyzxyz AKIA{"B" * 16} {"0a" * 12} {token} the/then/there-1-these-tests'
    df = frame(spark, [text, None, ""])
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    spans = [(x["kind"], text[x["s"] : x["e"]]) for x in got[1]["spans"]]
    assert spans == [("assign", "token:abcdef1"), ("access", "AKIA" + "B" * 16), ("hex", "0a" * 12), ("random", token)]
    assert got[2]["spans"] == [] == got[3]["base"]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert out[1].count("[SECRET]") == 4 and token not in out[1] and out[2] is None
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 11 and secrets.scan(empty).count() == 0


def test_secrets_among_written_tokens(spark):
    """Recall of planted random tokens, and the share of written ones among what is found."""
    rng = np.random.default_rng(11)
    words = "the of and to in is that for it was on are as with his they at be this have from or one had by word but not what all were when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split()
    alphabets = [secrets.ALPHABETS[k] for k in ("alnum", "base64", "base32")]
    texts, planted = [], set()
    for i in range(600):
        parts = [str(rng.choice(["-", "_", "/"])).join([*rng.choice(words, 7), str(rng.integers(0, 99))]) for _ in range(3)]
        if i % 4 == 0:
            token = "".join(rng.choice(list(alphabets[i // 4 % 3]), 44 + i % 3))
            parts.insert(1, token)
            planted.add((i + 1, token))
        texts.append(" ".join(parts))
    found = {(r["doc_id"], texts[r["doc_id"] - 1][x["s"] : x["e"]]) for r in secrets.scan(frame(spark, texts)).collect() for x in r["spans"] if x["kind"] == "random"}
    assert len(found & planted) >= 0.9 * len(planted), (len(found & planted), len(planted))
    assert len(found - planted) <= 0.05 * len(found), len(found - planted)


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(900, None), (1000, [0.0] * 8), (1001, [float("nan")] * 8), (1002, [None] * 8), (None, [1.0] * 8), (1003, [1.0]), (5, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert {r["query_id"] for r in got} == set(range(0, 900, 100))
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 90
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language ID", "line dedup", "near copies", "secret scan", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = p.language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    near = p.near_copies(spark, docs, "")
    groups = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    assert near.columns == docs.columns and near.count() == groups.select("component_id").distinct().count()
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.select("doc_id").distinct().count() <= kept.count() and out.count() > 0


def _sent(spark):
    """The most rows of a batch that a Python worker gets in this session."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return spark.range(0, 9000, 1, 1).mapInArrow(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["op6_brown", "pipeline"])
def test_batches_stay_small(spark, name):
    import corpus_pipeline as p

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    began, few = spark.conf.get(key), frame(spark, [DOG, "a b"])
    try:
        for given, most in ((10_000, common.ROWS), (0, common.ROWS), (7, 7)):
            spark.conf.set(key, given)
            if name == "pipeline":
                p.STAGES[3][1](spark, few, "")
            else:
                brown.score(few)
            assert _sent(spark) == most
    finally:
        spark.conf.set(key, began)
