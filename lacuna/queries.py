"""Named queries over the driver's tables, and the SQL that gives the same rows.

Operator numbers count from 1 at the root, parents first and left before right, without aliases and views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import COUNT, PICKY, compute_msrs, fetch_items, mark_items, rewrite
from .functions.question import twig

URGENT = {"o_orderpriority": "1-URGENT"}


def _table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


orders, customer, lineitem, part, events, nation, supplier = map(_table, ("orders", "customer", "lineitem", "part", "events", "nation", "supplier"))


def _msr(df: DataFrame, question: dict, **options) -> DataFrame:
    found = compute_msrs(df, twig(question), **options)
    return found.select(F.array_join(PICKY, ",").alias("picky"), F.col(COUNT).alias("compatible_count"))


def _sql(flags: dict[str, str], source: str, compatible: str, key: str = "k") -> str:
    """Rows of `source` that answer, by the operators whose flag isn't true."""
    parts = ", ".join(f"CASE WHEN NOT coalesce({f}, false) THEN '{oid}' END" for oid, f in flags.items())
    return f"SELECT concat_ws(',', {parts}) AS picky, count(DISTINCT {key}) AS compatible_count FROM ({source}) WHERE coalesce({compatible}, false) GROUP BY 1"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderpriority LIKE '%URG%'")
def twig_filter_orders(spark: SparkSession, d: str) -> DataFrame:
    return fetch_items(orders(spark, d), twig({"o_orderstatus": "F", "o_totalprice": "gtgtgtgt400000", "o_orderpriority": "containsURG"})).select("o_orderkey")


@query("SELECT c_custkey, (c_mktsegment NOT LIKE '%ING%' AND c_nationkey < 10 AND c_acctbal > 0) AS marked FROM customer")
def twig_mark_customer(spark, d):
    return mark_items(customer(spark, d), twig({"c_mktsegment": "nconnconING", "c_nationkey": "ltltltlt10", "c_acctbal": "gtgtgtgt0"}), "marked").select("c_custkey", "marked")


@query("SELECT p_partkey FROM part WHERE length(p_type) > 5 AND length(p_name) < 12 AND p_size = 7")
def twig_lengths_part(spark, d):
    return fetch_items(part(spark, d), twig({"p_type": "lengthgt5", "p_name": "lengthlt12", "p_size": "7"})).select("p_partkey")


@query("""SELECT l_orderkey FROM (SELECT l_orderkey, sum(CASE WHEN l_quantity > 40 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)
WHERE n BETWEEN 2 AND 3""")
def twig_array_cardinality(spark, d):
    nested = lineitem(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    return fetch_items(nested, twig({"items[2,3]": {"element": {"l_quantity": "gtgtgtgt40", "l_returnflag": "R"}}})).select("l_orderkey")


@query("SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1 HAVING count(*) FILTER (WHERE x > 0.3) BETWEEN 1 AND 20")
def twig_embedding_elements(spark, d):
    return fetch_items(spark.read.parquet(f"{d}/embeddings.parquet"), twig({"embedding[1,20]": {"element": "gtgtgtgt0.3"}})).select("vec_id")


@query("SELECT o_orderkey, o_totalprice > 250000 AS survived, o_orderpriority = '1-URGENT' AS compatible FROM orders")
def rewrite_filter_flags(spark, d):
    out = rewrite(orders(spark, d).filter("o_totalprice > 250000"), twig(URGENT))
    return out.select("o_orderkey", F.col("__SURVIVED_0001").alias("survived"), F.col("__COMPATIBLE_0001").alias("compatible"))


@query("""SELECT c_custkey, o_orderkey, coalesce(o_totalprice > 400000 AND c_custkey IS NOT NULL, false) AS survived,
coalesce(c_mktsegment = 'BUILDING', false) AND o_orderkey IS NOT NULL AS compatible FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000""")
def rewrite_join_flags(spark, d):
    c, o = customer(spark, d), orders(spark, d)
    out = rewrite(c.join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 400000)), twig({"c_mktsegment": "BUILDING"}))
    return out.select("c_custkey", "o_orderkey", F.col("__SURVIVED_0001").alias("survived"), F.col("__COMPATIBLE_0001").alias("compatible"))


@query("SELECT o_orderkey AS k, coalesce(part <> 'URGENT', false) AS survived, coalesce(part = 'URGENT', false) AS compatible FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders)")
def rewrite_explode_flags(spark, d):
    df = orders(spark, d).select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("part")).filter("part <> 'URGENT'")
    return rewrite(df, twig({"part": "URGENT"})).select(F.col("o_orderkey").alias("k"), F.col("__SURVIVED_0001").alias("survived"), F.col("__COMPATIBLE_0001").alias("compatible"))


@query(_sql({"0002": "a", "0001": "b"}, "SELECT o_orderkey AS k, o_orderstatus = 'F' AS a, o_totalprice > 250000 AS b, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_filter_chain(spark, d):
    return _msr(orders(spark, d).filter("o_orderstatus = 'F'").filter("o_totalprice > 250000"), URGENT)


@query(_sql({"0001": "a"}, "SELECT event_id AS k, props LIKE '%9%' AS a, event_type = 'purchase' AS c FROM events", "c"))
def msr_contains(spark, d):
    return _msr(events(spark, d).filter(F.contains("props", F.lit("9"))), {"event_type": "purchase"})


@query(_sql({"0003": "a", "0001": "b"}, "SELECT c_custkey AS k, c_acctbal > 0 AS a, c_nationkey < 12 AS b, c_mktsegment = 'BUILDING' AND c_nationkey > 5 AS c FROM customer", "c"))
def msr_project_rename(spark, d):
    df = customer(spark, d).filter("c_acctbal > 0").select(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("who"), "c_name")
    return _msr(df.filter("who.nation < 12"), {"who": {"segment": "BUILDING", "nation": "gtgtgtgt5"}})


@query(_sql({"0004": "a", "0001": "b"}, "SELECT c_custkey AS k, c_acctbal > 0 AS a, c_nationkey < 12 AS b, c_mktsegment = 'BUILDING' AS c FROM customer", "c"))
def msr_field_access(spark, d):
    df = customer(spark, d).filter("c_acctbal > 0").select(F.struct("c_mktsegment", "c_nationkey").alias("s"))
    df = df.select(F.col("s.c_mktsegment").alias("segment"), F.col("s.c_nationkey").alias("nation"))
    return _msr(df.filter("nation < 12"), {"segment": "BUILDING"})


_PARTS = "SELECT o_orderkey AS k, o_totalprice > 200000 AS s, unnest(string_split(o_orderpriority, '-')) AS part FROM orders"


@query(_sql({"0004": "s", "0001": "part <> 'URGENT'"}, _PARTS, "part = 'URGENT'"))
def msr_explode(spark, d):
    df = orders(spark, d).filter("o_totalprice > 200000").select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("part"))
    return _msr(df.filter("part <> 'URGENT'"), {"part": "URGENT"})


@query(_sql({"0004": "s", "0001": "part <> 'URGENT'"}, _PARTS, "part = 'URGENT'"))
def msr_posexplode(spark, d):
    df = orders(spark, d).filter("o_totalprice > 200000").select("o_orderkey", F.posexplode(F.split("o_orderpriority", "-")).alias("pos", "part"))
    return _msr(df.filter("part <> 'URGENT'"), {"part": "URGENT"})


_INLINED = "SELECT o_orderkey AS k, o_totalprice > 250000 AS a, o_orderpriority = '1-URGENT' AS c FROM orders"


@query(_sql({"0001": "a"}, _INLINED, "c"))
def msr_inline(spark, d):
    parts = F.array(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")))
    return _msr(orders(spark, d).select("o_orderkey", F.inline(parts)).filter("price > 250000"), {"priority": "1-URGENT"})


@query(_sql({"0002": "a"}, _INLINED, "c"))
def msr_sort(spark, d):
    return _msr(orders(spark, d).filter("o_totalprice > 250000").orderBy("o_totalprice"), URGENT)


@query(_sql({"0001": "p > 300000"}, "SELECT o_totalprice AS p, o_orderstatus = 'F' AND l_quantity > 49 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "c", "(k)").replace("count(DISTINCT (k))", "count(*)"))
def msr_right_join(spark, d):
    o, l = orders(spark, d), lineitem(spark, d)  # noqa: E741
    return _msr(l.join(o, o.o_orderkey == l.l_orderkey, "right").filter("o_totalprice > 300000"), {"o_orderstatus": "F", "l_quantity": "gtgtgtgt49"})


@query(_sql({"0002": "a"}, "SELECT c_nationkey AS k, c_acctbal > 0 AS a, c_mktsegment = 'BUILDING' AS c FROM customer", "c"))
def msr_collect_set(spark, d):
    df = customer(spark, d).filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    return _msr(df, {"segments": {"element": "BUILDING"}})


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice > 400000")
def twig_exists(spark, d):
    nested = orders(spark, d).select("o_orderkey", F.struct("o_totalprice", "o_orderpriority").alias("deep"))
    return fetch_items(nested, twig({"//o_orderpriority": "", "//o_totalprice": "gtgtgtgt400000"})).select("o_orderkey")


@query(_sql({"0004": "s"}, _PARTS, "part = 'URGENT'"))
def msr_explode_outer(spark, d):
    df = orders(spark, d).filter("o_totalprice > 200000").select("o_orderkey", F.explode_outer(F.split("o_orderpriority", "-")).alias("part"))
    # an outer explode keeps the flags of its input, so the question is filtered on what it gave
    out = rewrite(df, twig({"part": "URGENT"})).filter("part = 'URGENT' and __COMPATIBLE_0003")
    picky = F.when(F.col("__SURVIVED_0003"), "").otherwise("0004")
    return out.groupBy(picky.alias("picky")).agg(F.count_distinct("o_orderkey").alias("compatible_count"))


_JOINED = "SELECT {key} AS k, c_acctbal > 0 AS a, o_totalprice > 100000 AS b, o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING' AS c FROM customer JOIN orders ON c_custkey = o_custkey"


@query(_sql({"0003": "a", "0005": "b"}, _JOINED.format(key="o_orderkey"), "c"))
def msr_join(spark, d):
    c, o = customer(spark, d).filter("c_acctbal > 0"), orders(spark, d).filter("o_totalprice > 100000")
    return _msr(c.join(o, c.c_custkey == o.o_custkey).select("c_name", "o_orderpriority", "c_mktsegment"), URGENT | {"c_mktsegment": "BUILDING"})


@query(_sql({"0003": "a", "0006": "b"}, _JOINED.format(key="o_orderkey"), "c"))
def msr_join_using(spark, d):
    c, o = customer(spark, d).filter("c_acctbal > 0"), orders(spark, d).filter("o_totalprice > 100000").withColumnRenamed("o_custkey", "c_custkey")
    return _msr(c.join(o, "c_custkey"), URGENT | {"c_mktsegment": "BUILDING"})


@query(_sql({"0001": "p > 300000"}, "SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus = 'F' AND l_quantity > 49 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "c", "(k)").replace("count(DISTINCT (k))", "count(*)"))
def msr_left_join(spark, d):
    o, l = orders(spark, d), lineitem(spark, d)  # noqa: E741
    return _msr(o.join(l, o.o_orderkey == l.l_orderkey, "left").filter("o_totalprice > 300000"), {"o_orderstatus": "F", "l_quantity": "gtgtgtgt49"})


@query(_sql({"0001": "p > 300000"}, "SELECT o_totalprice AS p, o_orderstatus = 'F' AND l_quantity > 49 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "c", "(k)").replace("count(DISTINCT (k))", "count(*)"))
def msr_full_join(spark, d):
    o, l = orders(spark, d), lineitem(spark, d)  # noqa: E741
    return _msr(o.join(l, o.o_orderkey == l.l_orderkey, "full").filter("o_totalprice > 300000"), {"o_orderstatus": "F", "l_quantity": "gtgtgtgt49"})


@query(_sql({"0001": "m"}, "SELECT n_nationkey * 1000000 + s_suppkey AS k, n_nationkey = s_nationkey AND n_regionkey < 2 AS m, n_name = 'NATION_1' AND s_acctbal > 0 AS c FROM nation JOIN supplier ON n_nationkey < s_nationkey OR n_nationkey = s_nationkey", "c"))
def msr_theta_join(spark, d):
    n, s = nation(spark, d), supplier(spark, d)
    return _msr(n.join(s, n.n_nationkey <= s.s_nationkey).filter("n_nationkey = s_nationkey and n_regionkey < 2"), {"n_name": "NATION_1", "s_acctbal": "gtgtgtgt0"})


@query(_sql({"0001": "m"}, "SELECT n_nationkey * 1000000 + s_suppkey AS k, n_nationkey = s_nationkey AS m, n_name = 'NATION_1' AND s_acctbal > 0 AS c FROM nation CROSS JOIN supplier", "c"))
def msr_cross(spark, d):
    return _msr(nation(spark, d).crossJoin(supplier(spark, d)).filter("n_nationkey = s_nationkey"), {"n_name": "NATION_1", "s_acctbal": "gtgtgtgt0"})


_EXISTS = "SELECT c_custkey AS k, {no} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) AS m, c_mktsegment = 'BUILDING' AS c FROM customer"


@query(_sql({"0001": "m"}, _EXISTS.format(no=""), "c"))
def msr_semi(spark, d):
    c, o = customer(spark, d), orders(spark, d).filter("o_totalprice > 490000")
    return _msr(c.join(o, c.c_custkey == o.o_custkey, "left_semi"), {"c_mktsegment": "BUILDING"})


@query(_sql({"0001": "m"}, _EXISTS.format(no="NOT"), "c"))
def msr_anti(spark, d):
    c, o = customer(spark, d), orders(spark, d).filter("o_totalprice > 490000")
    return _msr(c.join(o, c.c_custkey == o.o_custkey, "left_anti"), {"c_mktsegment": "BUILDING"})


@query(_sql({"0002": "a"}, "SELECT c_nationkey AS k, c_acctbal > 0 AS a, c_mktsegment = 'BUILDING' AS c FROM customer", "c"))
def msr_aggregate(spark, d):
    df = customer(spark, d).filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("segments"))
    return _msr(df, {"segments": {"element": "BUILDING"}})


@query(_sql({"0002": "b", "0004": "a"}, "SELECT c_nationkey AS k, c_acctbal > 0 AS a, c_nationkey < 20 AS b, c_mktsegment = 'BUILDING' AS c FROM customer", "c"))
def msr_aggregate_nested(spark, d):
    inner = customer(spark, d).filter("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("balance"))
    df = inner.filter("c_nationkey < 20").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("segments"))
    return _msr(df, {"segments": {"element": "BUILDING"}})


@query(_sql({"0001": "n > 2800", "0003": "a"}, "SELECT o_orderpriority AS k, o_totalprice > 10000 AS a, count(*) OVER (PARTITION BY o_orderpriority) AS n, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_having(spark, d):
    orders(spark, d).createOrReplaceTempView("lacuna_orders")
    return _msr(spark.sql("SELECT o_orderpriority, count(*) AS n FROM lacuna_orders WHERE o_totalprice > 10000 GROUP BY 1 HAVING count(*) > 2800"), URGENT)


@query(_sql({"0002": "a"}, "SELECT o_orderkey AS k, o_orderstatus = 'F' AS a, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_sql_view(spark, d):
    orders(spark, d).createOrReplaceTempView("lacuna_orders")
    return _msr(spark.sql("SELECT x.o_orderkey, x.o_orderpriority FROM lacuna_orders AS x WHERE x.o_orderstatus = 'F'"), URGENT)


@query(_sql({"0002": "a"}, "SELECT o_orderpriority AS k, o_orderstatus = 'F' AS a, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_distinct(spark, d):
    return _msr(orders(spark, d).select("o_orderpriority", "o_orderstatus").filter("o_orderstatus = 'F'").dropDuplicates(["o_orderpriority"]), URGENT)


@query(_sql({"0001": "rn <= 100"}, "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_limit(spark, d):
    return _msr(orders(spark, d).orderBy("o_totalprice", "o_orderkey").limit(100), URGENT)


@query(_sql({"0001": "rn <= 3"}, "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_window(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return _msr(orders(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 3"), URGENT)


@query(_sql({"0002": "rn > 100", "0001": "rn <= 150"}, "SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_offset(spark, d):
    return _msr(orders(spark, d).orderBy("o_totalprice", "o_orderkey").offset(100).limit(50), URGENT)


_NATIONS = "SELECT c_nationkey AS k, c_acctbal > 0 AS a, c_nationkey {no} IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS m, c_nationkey < 10 AS c FROM customer"


@query(_sql({"0004": "a", "0002": "m"}, _NATIONS.format(no=""), "c"))
def msr_intersect(spark, d):
    c, s = customer(spark, d).filter("c_acctbal > 0"), supplier(spark, d).filter("s_acctbal > 9000")
    return _msr(c.select("c_nationkey").intersect(s.select("s_nationkey")), {"c_nationkey": "ltltltlt10"})


@query(_sql({"0004": "a", "0002": "m"}, _NATIONS.format(no="NOT"), "c"))
def msr_except(spark, d):
    c, s = customer(spark, d).filter("c_acctbal > 0"), supplier(spark, d).filter("s_acctbal > 9000")
    return _msr(c.select("c_nationkey").subtract(s.select("s_nationkey")), {"c_nationkey": "ltltltlt10"})


_SETS = "SELECT unnest([{keys}]) AS k, o_totalprice > 250000 AS a, o_orderpriority = '1-URGENT' AS c FROM orders"


@query(_sql({"0004": "a"}, _SETS.format(keys="o_orderstatus"), "c"))
def msr_rollup(spark, d):
    return _msr(orders(spark, d).filter("o_totalprice > 250000").rollup("o_orderstatus", "o_orderpriority").count(), URGENT)


@query(_sql({"0004": "a"}, _SETS.format(keys="o_orderstatus, 'all'"), "c"))
def msr_cube(spark, d):
    return _msr(orders(spark, d).filter("o_totalprice > 250000").cube("o_orderstatus", "o_orderpriority").count(), URGENT)


@query(_sql({"0004": "a", "0001": "b"}, "SELECT o_orderkey AS k, o_totalprice > 250000 AS a, o_orderstatus = 'F' AS b, o_orderpriority = '1-URGENT' AS c FROM orders", "c"))
def msr_stack(spark, d):
    df = orders(spark, d).filter("o_totalprice > 250000").selectExpr("o_orderstatus", "stack(2, 'priority', o_orderpriority, 'clerk', 'none') AS (kind, value)")
    return _msr(df.filter("o_orderstatus = 'F'"), {"value": "1-URGENT"})


@query(_sql({"0001": "a"}, _INLINED, "c"))
def msr_json_tuple(spark, d):
    made = orders(spark, d).select(F.to_json(F.struct("o_orderpriority", "o_totalprice")).alias("j"))
    return _msr(made.select(F.json_tuple("j", "o_orderpriority", "o_totalprice").alias("priority", "price")).filter("cast(price as double) > 250000"), {"priority": "1-URGENT"})


_UNION = """SELECT concat_ws(',', CASE WHEN NOT (branch = 1 AND s = 'F') THEN '0003' END, CASE WHEN NOT (branch = 2 AND s = 'O') THEN '0006' END{more}) AS picky, count(*) AS compatible_count
FROM (SELECT unnest([{branches}]) AS branch, o_orderstatus AS s, o_totalprice AS p FROM orders) WHERE p > 490000 GROUP BY 1"""


@query(_UNION.format(more="", branches="1, 2"))
def msr_union(spark, d):
    o = orders(spark, d)
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice")
    return _msr(pick("F").union(pick("O")), {"o_totalprice": "gtgtgtgt490000"})


@query(_UNION.format(more=", CASE WHEN NOT (branch = 3 AND p < 495000) THEN '0009' END", branches="1, 2, 3"))
def msr_union3(spark, d):
    o = orders(spark, d)
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice")
    return _msr(pick("F").union(pick("O")).union(o.filter("o_totalprice < 495000").select("o_custkey", "o_totalprice")), {"o_totalprice": "gtgtgtgt490000"})
