"""Question backtrace and relaxed plans, operator by operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicate import predicate
from ..functions.question import Node
from ..plans.catalyst import Catalyst

TRANSPARENT = {"SubqueryAlias", "View", "ReturnAnswer", "LocalLimit", "ResolvedHint"}
KEPT = {"Sort", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Window", "EventTimeWatermark"}
Question = dict[int, Node]  #: by the id of an attribute


def compatible(oid: int) -> str:
    return f"__COMPATIBLE_{oid:04d}"


def survived(oid: int) -> str:
    return f"__SURVIVED_{oid:04d}"


def collection(oid: int) -> str:
    return f"__PROVENANCE_COLLECTION_{oid:04d}"


@dataclass(frozen=True)
class Context:
    """The columns a plan has gained, in order: (name, nested context of a collection or None); and the newest flag."""

    columns: tuple[tuple[str, Context | None], ...] = ()
    flag: str = ""

    def plus(self, *names: str, flag: str | None = None, nested: Context | None = None) -> Context:
        return replace(self, columns=(*self.columns, *((n, nested) for n in names)), flag=flag or self.flag)

    def names(self) -> list[str]:
        return [n for n, _ in self.columns]


@dataclass
class Options:
    optimize: bool = False
    preserve_unmatched: bool = False
    unordered: bool = False  #: nothing looks at the order of rows, so sorts are left out
    operators: dict[str, str] = field(default_factory=dict)


class Relaxer:
    def __init__(self, spark, options: Options):
        self.c, self.options, self.count = Catalyst(spark), options, 0

    # -- backtrace ---------------------------------------------------------------------------------------------------

    def put(self, question: Question, attribute, node: Node) -> None:
        key = self.c.id(attribute)
        node = node.renamed(attribute.name())
        question[key] = question[key].merged(node) if key in question else node

    def place(self, question: Question, e, node: Node) -> None:
        """What a question about an expression asks of the attributes it is made of."""
        kind = self.c.kind(e)
        if kind == "AttributeReference":
            self.put(question, e, node)
        elif kind in ("Alias", "Cast", "ToPrettyString", "KnownNotNull", "TempResolvedColumn"):
            self.place(question, e.child(), node)
        elif kind == "GetStructField":
            name = e.childSchema().fields()[e.ordinal()].name()
            self.place(question, e.child(), Node("", children=(node.renamed(name),)))
        elif kind == "GetArrayStructFields":
            inner = node.children[0] if node.children else Node("element")
            element = Node("element", children=(inner.renamed(e.field().name()),))
            self.place(question, e.child(), Node("", node.min, node.max, children=(element,)))
        elif kind == "CreateNamedStruct":
            parts = self.c.items(e.children())
            for name, value in zip(parts[::2], parts[1::2], strict=True):
                for child in node.children:
                    if child.name == name.toString():
                        self.place(question, value, child)
        elif kind == "AggregateExpression":
            self.place_aggregate(question, e.aggregateFunction(), node)
        elif kind != "Literal":
            for a in self.c.items(e.references().toSeq()):
                self.put(question, a, Node(a.name()))

    def place_aggregate(self, question: Question, f, node: Node) -> None:
        children = self.c.items(f.children())
        if self.c.kind(f) in ("CollectList", "CollectSet"):
            if node.children:
                self.place(question, children[0], node.children[0])
        elif children:
            self.place(question, children[0], Node(""))

    def through(self, items: list, question: Question) -> Question:
        """The question below a list of named expressions."""
        below: Question = {}
        for e in items:
            if (node := question.get(self.c.id(e))) is not None:
                self.place(below, e, node)
        return below

    # -- relaxed plans -----------------------------------------------------------------------------------------------

    def names(self, node) -> int:
        self.count += 1
        self.options.operators[f"{self.count:04d}"] = node.simpleString(200)
        return self.count

    def fresh(self, plan, question: Question):
        """The compatibility of a plan's rows, from scratch."""
        ok = F.lit(True)
        for a in self.c.items(plan.output()):
            if (node := question.get(self.c.id(a))) is not None:
                ok = ok & predicate(node, self.c.column(a), self.c.data_type(a))
        return ok

    def relax(self, node, question: Question, early: bool, valued: bool = False) -> tuple[DataFrame, Context]:
        """The relaxed plan of a node whose output the question is about.

        early: rows that aren't compatible may go, and unmatched ones; not so below what evaluates compatibility again.
        valued: a condition above may look at values, so below an aggregate no row may go.
        """
        c, kind = self.c, self.c.kind(node)
        children = c.items(node.children())
        if kind in TRANSPARENT:
            return self.relax(children[0], question, early, valued)
        if kind in ("GlobalLimit", "Offset"):
            return self.limit(node, question)
        if kind in ("Intersect", "Except"):
            if node.isAll():
                raise NotImplementedError(f"no relaxed form of operator {kind} that counts copies")
            return self.relax(c.set_operation(node, "leftsemi" if kind == "Intersect" else "leftanti"), question, early, valued)
        oid = self.names(node)
        if not children:
            df = c.frame(node)
            df = df.select("*", self.fresh(node, question).alias(compatible(oid)))
            if early:
                df = df.filter(F.col(compatible(oid)))
            return df, Context().plus(compatible(oid), flag=compatible(oid))
        if kind == "Filter":
            df, x = self.relax(children[0], question, early, True)
            df = df.select("*", c.column(node.condition()).alias(survived(oid)), F.col(x.flag).alias(compatible(oid)))
            return df, x.plus(survived(oid), compatible(oid), flag=compatible(oid))
        if kind == "Project":
            items = c.items(node.projectList())
            df, x = self.relax(children[0], self.through(items, question), early, valued)
            return c.project([*items, *(c.attribute(df, n) for n in x.names())], c.analysed(df)), x
        if kind == "Generate":
            return self.generate(node, oid, children[0], question, early, valued)
        if kind == "Aggregate":
            grouping, items = c.items(node.groupingExpressions()), c.items(node.aggregateExpressions())
            return self.grouped(oid, grouping, items, children[0], question, early and not valued)
        if kind in ("Distinct", "Deduplicate"):
            keys = c.items(node.keys()) if kind == "Deduplicate" else c.items(children[0].output())
            own = {c.id(k) for k in keys}
            first = lambda a: c.alias(c.expression(F.first(c.column(a))), a.name(), a.exprId())
            items = [a if c.id(a) in own else first(a) for a in c.items(children[0].output())]
            return self.grouped(oid, keys, items, children[0], question, early and not valued)
        if kind == "Join":
            return self.joined(node, oid, children, question, early)
        if kind == "Union":
            return self.united(node, oid, children, question, early, valued)
        if kind == "Expand":
            return self.expanded(node, oid, children[0], question, early, valued)
        if kind == "Sort" and self.options.unordered:
            return self.relax(children[0], question, early, valued)
        if kind in KEPT:
            below = question
            if kind == "Window":
                outer = c.items(node.windowExpressions())
                below = {k: v for k, v in question.items() if k not in {c.id(e) for e in outer}}
                for k, v in self.through(outer, question).items():
                    below[k] = below[k].merged(v) if k in below else v
            df, x = self.relax(children[0], below, early and kind != "Window", valued)
            return c.replaced(node, c.analysed(df)), x
        raise NotImplementedError(f"no relaxed form of operator {kind}")

    def generate(self, node, oid, child, question, early, valued) -> tuple[DataFrame, Context]:
        c, generator = self.c, node.generator()
        outs = c.items(node.generatorOutput())
        asked = [question[c.id(o)] for o in outs if c.id(o) in question]
        below = {k: v for k, v in question.items() if k not in {c.id(o) for o in outs}}
        if c.kind(generator) in ("Explode", "PosExplode"):
            if (flat := question.get(c.id(outs[-1]))) is not None:
                self.place(below, generator.child(), Node("", flat.min, flat.max, children=(replace(flat, name="element", min=1, max=-1),)))
        elif c.kind(generator) == "Inline":
            if asked:
                self.place(below, generator.child(), Node("", children=(Node("element", children=tuple(asked)),)))
        elif c.kind(generator) in ("Stack", "JsonTuple"):
            # they give rows for every row, and what is asked of those is only known once they are there
            df, x = self.relax(child, below, False, valued)
            df = c.generate_outer(node, c.analysed(df))
            df = df.select("*", (self.fresh(node, question) & F.col(x.flag)).alias(compatible(oid)))
            return df, x.plus(compatible(oid), flag=compatible(oid))
        else:
            raise NotImplementedError(f"no relaxed form of generator {c.kind(generator)}")
        # an inner one evaluates compatibility again, so no row below it may go
        df, x = self.relax(child, below, early and node.outer(), valued)
        array = c.column(generator.child())
        relaxed = c.generate_outer(node, c.analysed(df))
        if node.outer():
            return relaxed, x
        ok = F.coalesce(array.isNotNull() & (F.size(array) > 0), F.lit(False))
        df = relaxed.select("*", ok.alias(survived(oid)), self.fresh(node, question).alias(compatible(oid)))
        if early:
            df = df.filter(F.col(compatible(oid)))
        return df, x.plus(survived(oid), compatible(oid), flag=compatible(oid))

    def expanded(self, node, oid, child, question, early, valued) -> tuple[DataFrame, Context]:
        """The rows of grouping sets, each compatible if what its set leaves of the row is."""
        c, outs = self.c, self.c.items(node.output())
        lists = [c.items(p) for p in c.items(node.projections())]
        below: Question = {}
        for k, o in enumerate(outs):
            if (asked := question.get(c.id(o))) is not None:
                for e in [p[k] for p in lists if c.kind(p[k]) != "Literal"][:1]:
                    self.place(below, e, asked)
        df, x = self.relax(child, below, early, valued)
        df = c.expand(lists, outs, df, x.names())
        df = df.select("*", (self.fresh(node, question) & F.col(x.flag)).alias(compatible(oid)))
        return df, x.plus(compatible(oid), flag=compatible(oid))

    def grouped(self, oid, grouping, items, child, question, early) -> tuple[DataFrame, Context]:
        c = self.c
        below = self.through(items, question)
        df, x = self.relax(child, below, early, False)
        more = [
            c.alias(c.expression(F.collect_list(F.struct(*(F.col(n) for n in x.names())))), collection(oid)),
            c.alias(c.expression(F.max(F.col(x.flag))), compatible(oid)),
        ]
        df = c.aggregate(grouping, [*items, *more], c.analysed(df))
        return df, Context().plus(collection(oid), nested=x).plus(compatible(oid), flag=compatible(oid))

    def joined(self, node, oid, children, question, early) -> tuple[DataFrame, Context]:
        c, how = self.c, node.joinType().toString()
        condition = node.condition().get() if node.condition().isDefined() else c.expression(F.lit(True))
        sides = [set(c.ids(x)) for x in children]
        asked = [{k: v for k, v in question.items() if k in side} for side in sides]
        if how in ("LeftSemi", "LeftAnti"):
            left, x = self.relax(children[0], asked[0], early, True)
            kind, flag = c.existence(f"__MATCH_{oid:04d}")
            df = c.join(node, c.analysed(left), children[1], kind, condition)
            ok = c.column(flag) if how == "LeftSemi" else ~c.column(flag)
            keep = [c.column(a) for a in c.items(c.analysed(left).output())]
            df = df.select(*keep, ok.alias(survived(oid)), F.col(x.flag).alias(compatible(oid)))
            return df, x.plus(survived(oid), compatible(oid), flag=compatible(oid))
        if how not in ("Inner", "Cross", "LeftOuter", "RightOuter", "FullOuter"):
            raise NotImplementedError(f"no relaxed form of a {how} join")
        alone = self.options.preserve_unmatched
        (left, x), (right, y) = (self.relax(ch, q, early and not alone, True) for ch, q in zip(children, asked, strict=True))
        # unmatched rows are never compatible, so without them nothing that is asked changes
        df = c.join(node, c.analysed(left), c.analysed(right), "inner" if early and not alone else "fullouter", condition)
        both = F.coalesce(F.col(x.flag) & F.col(y.flag), F.lit(False))
        if alone:
            one = [f for f, q in ((x.flag, asked[0]), (y.flag, asked[1])) if q]
            both = F.coalesce(F.col(one[0]), F.lit(False)) if len(one) == 1 else both
        ok = c.column(condition)
        for flag in (x.flag, y.flag):
            ok = ok & F.col(flag).isNotNull()
        df = df.select("*", F.coalesce(ok, F.lit(False)).alias(survived(oid)), both.alias(compatible(oid)))
        return df, Context((*x.columns, *y.columns)).plus(survived(oid), compatible(oid), flag=compatible(oid))

    def united(self, node, oid, children, question, early, valued) -> tuple[DataFrame, Context]:
        c, own = self.c, self.c.ids(node)
        parts, contexts = [], []
        for child in children:
            outputs = c.items(child.output())
            below: Question = {}
            for k, a in zip(own, outputs, strict=True):
                if k in question:
                    self.put(below, a, question[k])
            df, x = self.relax(child, below, early, valued)
            parts.append((df, [c.column(a) for a in outputs], x))
            contexts.append(x)
        columns = tuple(col for x in contexts for col in x.columns)
        kinds = {n: df.schema[n].dataType for df, _, x in parts for n in x.names()}
        frames = []
        for df, outputs, x in parts:
            mine = set(x.names())
            prov = [F.col(n) if n in mine else F.lit(None).cast(kinds[n]).alias(n) for n, _ in columns]
            frames.append(df.select(*outputs, *prov, F.col(x.flag).alias(compatible(oid))))
        df = c.union([c.analysed(f) for f in frames])
        return df, Context(columns).plus(compatible(oid), flag=compatible(oid))

    def sort_key(self, order):
        col = self.c.column(order.child())
        way = "asc" if order.direction().toString() == "Ascending" else "desc"
        return getattr(col, f"{way}_nulls_{'first' if order.nullOrdering().toString() == 'NullsFirst' else 'last'}")()

    def limit(self, node, question) -> tuple[DataFrame, Context]:
        """Rows beyond the limit or before the offset, in the order of a sort below, don't survive; all are numbered in one task."""
        c, oid = self.c, self.names(node)

        def below(plan):
            plan = c.items(plan.children())[0]
            return below(plan) if c.kind(plan) in TRANSPARENT else plan

        child = sort = below(node)
        skipped = F.lit(0)
        if c.kind(node) == "GlobalLimit" and c.kind(child) == "Offset":
            # both number the same rows, so the limit counts from where the offset ends
            skipped, sort = c.column(child.offsetExpr()), below(child)
        sorts = c.items(sort.order()) if c.kind(sort) == "Sort" else []
        order = [self.sort_key(o) for o in sorts] or [F.monotonically_increasing_id()]
        df, x = self.relax(c.items(child.children())[0] if c.kind(child) == "Sort" else child, question, False)
        at = F.row_number().over(Window.orderBy(*order))
        ok = at <= c.column(node.limitExpr()) + skipped if c.kind(node) == "GlobalLimit" else at > c.column(node.offsetExpr())
        df = df.select("*", ok.alias(survived(oid)), F.col(x.flag).alias(compatible(oid)))
        return df, x.plus(survived(oid), compatible(oid), flag=compatible(oid))
