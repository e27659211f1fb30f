"""Secret scans in SQL functions: known forms, and tokens that pass a battery of randomness tests under a false-discovery rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, every

#: Fixed values of the contract: forms of known secrets, and the least length of what counts.
_KEY = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

TOKEN, TOKEN_LEAST = r"[A-Za-z0-9+/_=-]+", 20
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Of written words: sum of squares of the shares of characters, at least; that sum times the size of a narrow alphabet;
#: and the sum of cubes, by the square of the sum of squares.
TEXT_2, TEXT_NARROW, TEXT_3 = 0.0655, 1.73, 1.352
LOST, RATE = 0.01, 0.05  #: share of random tokens among those the battery rejects, and of written ones among those found
BINS = 2  #: bins of p-values per factor of two


def _spans(text: Column, pattern: str, kind: str, keep, group: int = 0) -> Column:
    """Spans of the matches that `keep` accepts (given the match's group), in code points, the end exclusive.

    The pieces between matches and the matches alternate, so that their lengths add up to places.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("len"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,kind:string,value:string>>)").alias("out"))

    def add(acc, part):
        start = acc["at"] + part["gap"]
        end = start + F.coalesce(part["len"], F.lit(0))
        span = F.struct(start.alias("s"), end.alias("e"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        ok = part["len"].isNotNull() & keep(part["value"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, add, lambda acc: acc["out"])


def _found(text: Column, probe: Column, spans: Column) -> Column:
    """The spans where the cheap probe holds, else none."""
    return F.when(probe, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,kind:string,value:string>>)"))


def _normal(z: Column) -> Column:
    """Share of a normal distribution below z."""
    # the error function by a fixed rational approximation of absolute error 1.2e-7 (a Chebyshev fit), good in the far tail
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(fit[-1])
    for c in fit[-2::-1]:
        poly = poly * t + c
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The narrowest alphabet that holds the token; none without a digit and a letter, as words and numbers have."""
    bare = F.rtrim(token, F.lit("="))
    kind = F.when(bare.rlike("^[0-9a-f]+$") | bare.rlike("^[0-9A-F]+$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").when(bare.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    return F.when(bare.rlike("[0-9]") & bare.rlike("[A-Za-z]"), kind)


def battery(token: Column) -> Column:
    """Struct (p_uniform, p_runs, p_serial, p_random, p_text) of a token, null for one without an encoding.

    The first three are levels at which its symbols, as numbers in the alphabet, look random: chi-squared against
    uniform shares, runs above and below the middle, serial correlation; p_random combines them by Fisher's method.
    p_text is the chance that written words are as uniform as the token; it falls with length.
    """
    kind = encoding(token)
    symbols = F.lit(ALPHABETS["base64"])
    for name, alphabet in ALPHABETS.items():
        symbols = F.when(kind == name, F.lit(alphabet)).otherwise(symbols)
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    bare = F.when(kind == "hex", F.lower(bare)).otherwise(bare)

    def stats(v):
        text, alphabet, chars, place, high = (v[c] for c in ("text", "alphabet", "chars", "place", "high"))
        n, a = F.size(chars).cast("double"), F.length(alphabet).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
        chi, df = a / n * squares - n, a - 1
        wilson = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n1 = F.aggregate(high, F.lit(0), lambda acc, x: acc + x).cast("double")
        n0 = n - n1
        pairs = F.sequence(F.lit(2), F.size(chars))
        runs = F.aggregate(pairs, F.lit(1), lambda acc, i: acc + (F.element_at(high, i) != F.element_at(high, i - 1)).cast("int")).cast("double")
        m = 2 * n1 * n0 / n + 1
        z_runs = (runs - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(1e-9)))
        mean = v["mean"]
        var = F.aggregate(place, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        lag = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + (F.element_at(place, i) - mean) * (F.element_at(place, i - 1) - mean))
        z_serial = (lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        # under written words: mean and variance of the sum of squares of counts of n draws
        share = F.greatest(F.lit(TEXT_2), TEXT_NARROW / a)
        mean_2 = n + n * (n - 1) * share
        var_2 = 2 * n * (n - 1) * (share - share * share) + 4 * n * (n - 1) * (n - 2) * (TEXT_3 - 1) * share * share
        two = lambda z: 2 * _normal(-F.abs(z))
        return F.struct((1 - _normal(wilson)).alias("p_uniform"), two(z_runs).alias("p_runs"), two(z_serial).alias("p_serial"), _normal((squares - mean_2) / F.sqrt(var_2)).alias("p_text"))

    def combined(v):
        # minus the sum of logarithms of three levels, if random, is over y with chance exp(-y) (1 + y + y * y / 2)
        return {"p_random": F.exp(-v["y"]) * (1 + v["y"] + v["y"] * v["y"] / 2)}

    # each step binds what the next one uses, as a lambda evaluates whatever it doesn't take as a variable for each element
    step = lambda rows, f: F.transform(rows, lambda v: F.struct(*(v[c].alias(c) for c in f[0]), *(x.alias(c) for c, x in f[1](v).items())))
    values = F.array(F.struct(bare.alias("text"), symbols.alias("alphabet"), F.split(bare, "").alias("chars")))
    values = step(values, (["text", "alphabet", "chars"], lambda v: {"place": F.transform(v["chars"], lambda c: (F.instr(v["alphabet"], c) - 1).cast("double"))}))
    values = step(values, (["text", "alphabet", "chars", "place"], lambda v: {"high": F.transform(v["place"], lambda x: (x * 2 >= F.length(v["alphabet"])).cast("int")), "mean": F.aggregate(v["place"], F.lit(0.0), lambda acc, x: acc + x) / F.size(v["place"])}))
    values = F.transform(values, stats)
    tests = ["p_uniform", "p_runs", "p_serial"]
    values = step(values, ([*tests, "p_text"], lambda v: {"y": -sum((F.ln(F.greatest(v[c], F.lit(1e-100))) for c in tests), F.lit(0.0))}))
    values = step(values, ([*tests, "p_text"], combined))
    return F.when(kind.isNotNull(), F.element_at(values, 1))


def _band(length: Column) -> Column:
    return F.least(F.floor(F.log2(length.cast("double")) * 2), F.lit(40)).cast("int")


def _level(p: Column) -> Column:
    """The bin of a p-value, the higher the smaller it is."""
    return F.least(F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * BINS), F.lit(2000)).cast("int")


def _rejected(bins: DataFrame, rate: float) -> Column | None:
    """Least rejected bin of each band by the procedure of Benjamini and Hochberg at `rate`, as a map; None if there is none.

    bins holds band, bin and n: at most 40 bands of 2000 bins, whatever the input. Each bin counts as its upper end.
    """
    w = Window.partitionBy("band")
    ranked = bins.withColumn("m", F.sum("n").over(w)).withColumn("k", F.sum("n").over(w.orderBy(F.desc("bin"))))
    passed = ranked.filter(F.pow(F.lit(2.0), -F.col("bin") / BINS) <= rate * F.col("k") / F.col("m")).groupBy("band").agg(F.min("bin").alias("bin"))
    limits = {r["band"]: r["bin"] for r in passed.collect()}
    return F.create_map(*(F.lit(v).cast("int") for pair in limits.items() for v in pair)) if limits else None


def scan(docs: DataFrame, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of known forms) and spans (those and the random tokens), sorted; with `keep`, the row as a struct.

    A span is a struct s, e, kind in code points. A random token is a run of TOKEN_LEAST or more characters of an
    encoding, apart from every known form, that the three tests together don't reject as random (p_random, at the
    false-discovery rate LOST: of what they reject, so many are random) and that is rejected as written (p_text, at
    RATE), both among the candidates of like length in all documents (the procedure of Benjamini and Hochberg on binned
    values, each bin counting as its upper end).

    A null text is empty. Null ids and repeated rows stay; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = ["__row"] if keep else []
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), *([F.struct(*every(docs)).alias("__row")] if keep else []), text.alias("__t"))
    t = F.col("__t")
    long = lambda kind: lambda v: F.length(v) >= LEAST[kind]
    assign = _found(t, t.rlike(ASSIGN), _spans(t, ASSIGN, "assign", long("assign"), 2))
    access = _found(t, F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, "access", long("access")))
    hexes = _found(t, t.rlike(HEX[:-1] + "{24}"), _spans(t, HEX, "hex", long("hex")))
    random = _found(t, t.rlike(TOKEN[:-1] + "{20}"), _spans(t, TOKEN, "random", lambda v: (F.length(v) >= TOKEN_LEAST) & encoding(v).isNotNull()))
    df = df.select("doc_id", *kept, assign.alias("a"), access.alias("b"), hexes.alias("c"), random.alias("r"))
    order = lambda s: F.array_sort(F.transform(s, lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    base = order(F.concat("a", "b", "c"))
    df = df.select("doc_id", *kept, base.alias("base"), "r")
    apart = F.filter("r", lambda r: ~F.exists("base", lambda x: (x["s"] < r["e"]) & (r["s"] < x["e"])))
    tested = F.transform(apart, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), _band(r["e"] - r["s"]).alias("band"), battery(r["value"]).alias("p")))
    df = cut(df.select("doc_id", *kept, "base", tested.alias("r")))

    each = df.select(F.explode("r").alias("r")).select("r.band", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), _level(F.col(f"r.p.{c}")).alias("bin")) for c in ("p_random", "p_text")))).alias("x"))
    bins = cut(each.groupBy("x.of", "band", "x.bin").agg(F.count("*").alias("n")))
    other, written = (_rejected(bins.filter(F.col("of") == c), rate) for c, rate in (("p_random", LOST), ("p_text", RATE)))

    def passes(r):
        if written is None:
            return F.lit(False)
        least = lambda bound: F.element_at(bound, r["band"])
        random_ = F.lit(True) if other is None else F.coalesce(_level(r["p"]["p_random"]) < least(other), F.lit(True))
        return F.coalesce(random_ & (_level(r["p"]["p_text"]) >= least(written)), F.lit(False))

    more = F.transform(F.filter("r", passes), lambda r: F.struct(r["s"].alias("s"), F.lit(4).cast("long").alias("k"), r["e"].alias("e"), F.lit("random").alias("kind")))
    return df.select("doc_id", *kept, "base", F.array_sort(F.concat(F.col("base"), more)).alias("spans"))


def _written(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with each secret in the text (overlapping ones together) replaced by the mark. A null text stays null."""
    found = scan(docs, True, id_col, text_col)
    old = F.col("__row")[text_col]
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, x):
        gap = F.substring(old, acc["at"] + 1, x["s"] - acc["at"])
        fresh = F.struct(F.concat(acc["out"], gap, F.lit(mark)).alias("out"), x["e"].alias("at"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))
        return F.when(x["s"] >= acc["at"], fresh).otherwise(inside)

    text = F.aggregate("spans", zero, put, lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.size("spans") > 0, text).otherwise(old)
    return found.select(*(text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *map(_number, ("assign", "access", "hex")), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
