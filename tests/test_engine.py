"""The question language, the condition, backtrace and relaxed operators, and the sets of operators."""

import importlib.util
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna import queries as named
from lacuna.api import compute_msrs, explain, fetch_items, mark_items, rewrite, rewrite_with_context
from lacuna.functions.question import Twig, match_all, match_unique, parse_condition, serialize, twig
from lacuna.operators.relax import Options, Relaxer

DATA = "/root/testdata/sf0.001"


def rows(df):
    return {(tuple(r["pickyOperators"]), r["compatibleCount"]) for r in df.collect()}


def schema(text):
    return T._parse_datatype_string(text)


@pytest.fixture(scope="module")
def ints(spark):
    return spark.createDataFrame([(i,) for i in range(1, 7)], "n int")


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([("1", 1), ("2", 2), ("1", 3), ("3", 4), ("3", 5), ("2", 6), ("1", 7), ("4", 8)], "key string, value long")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("1", 1), ("2", 2), ("1", 3), ("3", 4), ("3", 5), ("2", 6), ("1", 7), ("5", 8)], "key string, other long")


@pytest.fixture(scope="module")
def people(spark):
    kind = "name string, address2 array<struct<city:string,year:long>>"
    return spark.createDataFrame([("Peter", [("LA", 2010), ("SF", 2018)]), ("Sue", [("LA", 2019), ("NY", 2018)])], kind)


def pattern(root, *edges):
    t, nodes = Twig(), {}
    nodes[root] = t.node(root)
    for parent, child, deep in edges:
        nodes[child] = t.node(child)
        t.edge(nodes[parent], nodes[child], deep)
    return t.validate()


DOC1 = "root struct<a: struct<a: struct<c: struct<c: struct<e: struct<g: long>>, d: struct<f: long>>>, b: long>>"
DOC3 = "root struct<a: struct<a: struct<c: struct<c: struct<e: struct<g: long>, f: long>, d: struct<f: long>>>, b: long>>"


@pytest.mark.parametrize(
    "doc, edges, n",
    [
        (DOC1, [("a", "b", 0), ("a", "c", 1), ("c", "f", 1), ("c", "g", 1)], 1),
        (DOC1, [("a", "c", 1), ("c", "f", 1), ("c", "g", 1)], 2),
        (DOC1, [("a", "c", 1), ("c", "g", 1)], 4),
        (DOC3, [("a", "c", 1), ("c", "g", 1), ("c", "f", 1)], 6),
    ],
)
def test_embeddings(spark, doc, edges, n):
    inner = schema(doc)["root"].dataType
    assert len(match_all(pattern("a", *((p, c, bool(d)) for p, c, d in edges)), inner)) == n


def test_twig_rules():
    t = Twig()
    a, b = t.node("a"), t.node("b")
    with pytest.raises(ValueError):
        t.validate()
    with pytest.raises(ValueError):
        _ = t.root
    t.edge(a, b)
    assert t.validate().root is a and '"name": "b"' in t.to_json()
    with pytest.raises(ValueError):
        t.edge(a, b)
    t.node("c", 3, 2)
    with pytest.raises(ValueError):
        t.validate()
    with pytest.raises(ValueError):
        parse_condition("lengthgtx")


def test_serialized(spark):
    kind = schema("flat_list array<string>")
    node = match_unique(twig({"flat_list[1,5]": {"element": "contains_1"}}), kind)
    assert serialize(node) == [(0, 0, 0, 1, -1, "root", ""), (1, 0, 0, 1, 5, "flat_list", ""), (2, 1, 2, 1, -1, "element", "_1")]


def test_ambiguous_question(spark):
    with pytest.raises(ValueError):
        match_unique(twig({"//x": None}), schema("a struct<x: int>, b struct<x: int>"))


def test_conditions(spark, ints):
    assert fetch_items(ints, twig({"n": "gtgtgtgt4"})).count() == 2
    assert fetch_items(ints, twig({"n": "3"})).count() == 1
    assert fetch_items(ints, twig({"n": "three"})).count() == 0
    assert mark_items(ints, twig({"n": "ltltltlt3"}), "m").filter("m").count() == 2
    df = spark.createDataFrame([("abc", [1, 2], None), (None, [], 1.5), ("x", None, 2.5), ("abcd", [3, None], 0.5)], "s string, a array<int>, d double")
    count = lambda q: fetch_items(df, twig(q)).count()
    assert count({"s": None}) == 3 and count({"s": "containsbc"}) == 2 and count({"s": "nconnconbc"}) == 1
    assert count({"s": "lengthgt3"}) == 1 and count({"s": "lengthlt2"}) == 1 and count({"s": "ltltltlt3"}) == 0
    assert count({"a": None}) == 2 and count({"a[0,5]": None}) == 3 and count({"a[2,2]": {"element": None}}) == 1
    assert count({"d": "gtgtgtgt1"}) == 2 and count({"d": "1.5"}) == 1
    assert {r["m"] for r in mark_items(df, twig({"d": "ltltltlt1"}), "m").collect()} == {True, False}


def test_filter_flags(ints):
    out, context = rewrite_with_context(ints.filter("n > 2"), twig({"n": "3"}))
    assert context.names() == ["__COMPATIBLE_0002", "__SURVIVED_0001", "__COMPATIBLE_0001"]
    assert out.filter("__SURVIVED_0001").count() == 4 and out.filter("__COMPATIBLE_0001").count() == 1 and out.count() == 6


def test_filter_answer(ints):
    assert rows(compute_msrs(ints.filter("n > 10"), twig({"n": None}))) == {(("0001",), 6)}
    assert rows(compute_msrs(ints.filter("n > null"), twig({"n": None}))) == {(("0001",), 6)}


def test_running_example(people):
    q = people.withColumn("address", F.explode("address2")).filter("address.year >= 2019").select("name", F.col("address.city").alias("city"))
    q = q.groupBy("city").agg(F.collect_list("name").alias("names"))
    for optimize in (True, False):
        assert rows(compute_msrs(q, twig({"city": "NY"}), optimize=optimize)) == {(("0003",), 1)}
    assert "year" in explain(q, twig({"city": "NY"})).first()["operators"][0]


def test_two_fields_of_a_struct(people):
    q = people.withColumn("a", F.explode("address2")).select("name", "a.city", "a.year").filter("year > 2030")
    assert rows(compute_msrs(q, twig({"city": "LA", "year": "2019", "name": "Sue"}))) == {(("0001",), 1)}


def test_explode_keeps_empty(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "k string, l array<string>")
    out = rewrite(df.select("k", F.explode("l").alias("v")), twig({"k": None}))
    assert {(r["k"], r["__SURVIVED_0002"]) for r in out.collect()} == {("a", True), ("b", False), ("c", False)}
    assert rows(compute_msrs(df.select("k", F.explode("l").alias("v")), twig({"k": "b"}))) == {(("0002",), 1)}


def test_join(left, right):
    q = left.join(right, "key")
    out = rewrite(q, twig({"key": None}))
    assert q.count() == 17 and out.count() == 19 and out.filter("__SURVIVED_0002").count() == 17
    for how in ("inner", "left"):
        out = rewrite(left.join(right, "key", how), twig({"key": None})).filter("key = '4'").collect()
        assert [r["__SURVIVED_0002"] for r in out] == [False]
    assert rows(compute_msrs(left.join(right, "key", "left_anti"), twig({"key": "1"}))) == {(("0002",), 3)}
    assert rows(compute_msrs(left.filter("value > 100").join(right, "key"), twig({"key": "4"}))) == set()
    kept = compute_msrs(left.filter("value > 100").join(right, left.key == right.key), _left_only(), preserve_unmatched=True)
    assert rows(kept) == {(("0002", "0001"), 1)}


def _left_only():
    return twig({"value": "8"})


def test_self_join(left):
    a, b = left.alias("a"), left.filter("value > 4").alias("b")
    q = a.join(b, F.col("a.key") == F.col("b.key")).select(F.col("a.value").alias("x"), F.col("b.value").alias("y"))
    assert rows(compute_msrs(q, twig({"x": "1", "y": "3"}))) == {(("0004",), 1)}


def test_aggregate(left):
    q = left.filter("value > 6").groupBy("key").agg(F.sum("value").alias("s"))
    out, context = rewrite_with_context(q, twig({"key": "2"}))
    fields = out.schema["__PROVENANCE_COLLECTION_0001"].dataType.elementType.names
    assert fields == ["__COMPATIBLE_0003", "__SURVIVED_0002", "__COMPATIBLE_0002"] and context.flag == "__COMPATIBLE_0001"
    assert rows(compute_msrs(q, twig({"key": "2"}))) == {(("0002",), 1)}
    assert rows(compute_msrs(q.filter("s > 1000"), twig({"key": "1"}))) == {(("0001",), 1), (("0001", "0003"), 1)}


def test_union_flags(left, spark):
    other = spark.createDataFrame([("5", 1), ("2", 2)], "k string, v long")
    q = left.filter("value > 100").union(other.filter("v > 100"))
    assert rows(compute_msrs(q, twig({"key": "5"}))) == {(("0002", "0004"), 1)}
    assert rows(compute_msrs(q, twig({"key": "5"}), branch_aware=True)) == {(("0004",), 1)}


def test_limit_and_distinct(left):
    assert rows(compute_msrs(left.orderBy("value").limit(2), twig({"key": "3"}))) == {(("0001",), 2)}
    assert rows(compute_msrs(left.select("key").distinct().filter("key > 5"), twig({"key": "3"}))) == {(("0001",), 1)}


def test_unknown_operator(left):
    with pytest.raises(NotImplementedError):
        compute_msrs(left.select("key").intersectAll(left.select("key")), twig({"key": "1"}))


def test_backtrace(people, spark):
    q = people.select(F.struct(F.col("name").alias("n"), F.col("address2").alias("a")).alias("s"))
    relaxer = Relaxer(spark, Options())
    plan = relaxer.c.analysed(q)
    root = match_unique(twig({"s": {"n": "Sue", "a[1,2]": {"element": {"city": "NY"}}}}), q.schema)
    below = relaxer.through(relaxer.c.items(plan.projectList()), {relaxer.c.id(plan.output().apply(0)): root.children[0]})
    assert {n.name: [c.name for c in n.children] for n in below.values()} == {"name": [], "address2": ["element"]}
    assert {(n.min, n.max) for n in below.values()} == {(1, -1), (1, 2)}


@pytest.mark.parametrize("name", sorted(named.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    df, sql = named.QUERIES[name](spark, DATA), con.sql(named.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    key = lambda r: str(r)
    at = [sql.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=key)


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).columns == ["picky", "compatible_count"]
    assert set(module.oracle_sql()) <= set(module.queries())


def test_sorts_are_left_out_and_samples_refused(spark):
    df = spark.range(100).filter("id > 50").orderBy("id")
    found = compute_msrs(df, twig({"id": "7"}))
    assert "Sort" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["pickyOperators"], r["compatibleCount"]) for r in found.collect()] == [(["0002"], 1)]
    with pytest.raises(NotImplementedError):
        compute_msrs(spark.range(100).sample(0.1, 3), twig({"id": "7"}))


def test_explain_takes_all_options(spark):
    rows = explain(spark.range(9).filter("id > 5"), twig({"id": "3"}), optimize=False, preserve_unmatched=True, branch_aware=True).collect()
    assert len(rows) == 1 and rows[0]["pickyOperators"] == ["0001"] and "Filter" in rows[0]["operators"][0]


def test_offset_and_limit(ints):
    """The limit counts from where the offset ends; an offset alone is to blame for the rows before it."""
    both = ints.orderBy("n").offset(2).limit(2)
    assert rows(compute_msrs(both, twig({"n": "1"}))) == {(("0002",), 1)}
    assert rows(compute_msrs(both, twig({"n": "4"}))) == {((), 1)}
    assert rows(compute_msrs(both, twig({"n": "5"}))) == {(("0001",), 1)}
    assert rows(compute_msrs(ints.orderBy("n").offset(2), twig({"n": "1"}))) == {(("0001",), 1)}


def test_set_operations_with_nulls(spark):
    """Nulls are equal to each other, and a side may be the other one filtered."""
    df = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "n int, s string")
    some = df.filter("n < 3")
    for o in (True, False):
        assert rows(compute_msrs(df.intersect(some), twig({"n": "1"}), optimize=o)) == {((), 1)}
        assert rows(compute_msrs(df.intersect(some), twig({"n": "3"}), optimize=o)) == {(("0002",), 1)}
        assert rows(compute_msrs(df.subtract(some), twig({"n": "2"}), optimize=o)) == {(("0002",), 1)}
    assert rows(compute_msrs(df.limit(0).intersect(some), twig({"n": "9"}))) == set()


def test_grouping_sets(left):
    """A row that a set leaves without the asked value isn't compatible."""
    for df in (left.filter("value > 3").rollup("key").count(), left.filter("value > 3").cube("key").count()):
        assert rows(compute_msrs(df, twig({"key": "1"}))) == rows(compute_msrs(df, twig({"key": "1"}), optimize=False)) == {(("0004",), 1), ((), 1)}


def test_stack_of_null_and_empty(spark, left):
    df = left.filter("value > 1").selectExpr("stack(2, key, null, 'x', key) AS (a, b)")
    assert rows(compute_msrs(df, twig({"a": "1"}))) == {(("0003",), 1), ((), 2)}
    assert rows(compute_msrs(left.limit(0).selectExpr("stack(1, key) AS a"), twig({"a": "1"}))) <= {(("0003",), 3)}
