"""Why is an expected row missing? Relaxed results with provenance flags, and the sets of operators to blame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.predicate import row_predicate
from .functions.question import Twig, match_unique
from .operators.relax import Context, Options, Relaxer

ID, PICKY, COUNT = "__ID", "pickyOperators", "compatibleCount"


def matching(df: DataFrame, question: Twig):
    """The condition that a row answers the question."""
    return row_predicate(match_unique(question, df.schema), df.schema)


def fetch_items(df: DataFrame, question: Twig) -> DataFrame:
    """The rows that answer the question."""
    return df.filter(matching(df, question))


def mark_items(df: DataFrame, question: Twig, column: str) -> DataFrame:
    """All rows, with whether they answer the question."""
    return df.withColumn(column, matching(df, question))


def rewrite_with_context(df: DataFrame, question: Twig, options: Options | None = None) -> tuple[DataFrame, Context]:
    options = options or Options()
    root = match_unique(question, df.schema)
    relaxer = Relaxer(df.sparkSession, options)
    plan = relaxer.c.analysed(df)
    asked = {n.name: n for n in root.children}
    outputs = relaxer.c.items(plan.output())
    return relaxer.relax(plan, {relaxer.c.id(a): asked[a.name()] for a in outputs if a.name() in asked}, options.optimize)


def rewrite(df: DataFrame, question: Twig) -> DataFrame:
    """The relaxed result: rows that the query drops are there too, with flags per operator."""
    return rewrite_with_context(df, question)[0]


def _number(name: str) -> str:
    return name.rsplit("_", 1)[1]


def msr(df: DataFrame, context: Context, null_is_picky: bool = True, branch_aware: bool = False) -> DataFrame:
    """Sets of operators that dropped compatible rows, with the number of top-level rows each set concerns.

    branch_aware: survivor flags that a union filled with nulls aren't held against a row, and rows whose other branch
    aggregates stay.
    """
    df = df.select(*context.names()).withColumn(ID, F.monotonically_increasing_id()).filter(F.col(context.flag))
    found: list[str] = []
    explode = F.explode_outer if branch_aware else F.explode
    level = list(context.columns)
    plain = [n for n, x in level if x is None]
    nested = [(n, x) for n, x in level if x is not None]
    found += [n for n in plain if n.startswith("__SURVIVED")]
    while nested:
        name, x = nested.pop(0)
        df = df.withColumn("__m", explode(name))
        ok = F.col("__m")[x.flag]
        df = df.filter(F.coalesce(ok, F.col("__m").isNull()) if branch_aware else ok)
        df = df.select(*(c for c in df.columns if c not in (name, "__m")), *(F.col("__m")[n].alias(n) for n in x.names()))
        found += [n for n in x.names() if n.startswith("__SURVIVED")]
        nested += [(n, y) for n, y in x.columns if y is not None]
    lost = lambda n: ~F.coalesce(F.col(n), F.lit(branch_aware or not null_is_picky))
    picky = [F.when(lost(n), F.lit(_number(n))) for n in found]
    array = F.array_compact(F.array(*picky)) if picky else F.array().cast("array<string>")
    return df.select(array.alias(PICKY), ID).groupBy(PICKY).agg(F.count_distinct(ID).alias(COUNT))


def compute_msrs(df: DataFrame, question: Twig, optimize: bool = True, null_is_picky: bool = True, branch_aware: bool = False, preserve_unmatched: bool = False) -> DataFrame:
    """pickyOperators and compatibleCount for a question about a missing row of df.

    optimize drops incompatible rows early and joins inner where neither changes the answer.
    """
    options = Options(optimize=optimize, preserve_unmatched=preserve_unmatched, unordered=True)
    return msr(*rewrite_with_context(df, question, options), null_is_picky=null_is_picky, branch_aware=branch_aware)


def explain(df: DataFrame, question: Twig, optimize: bool = True, preserve_unmatched: bool = False, **options) -> DataFrame:
    """compute_msrs with the text of each operator beside its number."""
    o = Options(optimize=optimize, preserve_unmatched=preserve_unmatched, unordered=True)
    found = msr(*rewrite_with_context(df, question, o), **options)
    texts = F.create_map(*(F.lit(x) for kv in o.operators.items() for x in kv))
    return found.withColumn("operators", F.transform(PICKY, lambda i: texts[i]))
