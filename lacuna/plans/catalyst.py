"""The one module that touches the JVM: a view of analysed plans, and building plans from their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import DataType, _parse_datatype_json_string


class Catalyst:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.logical = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self.expressions = self.jvm.org.apache.spark.sql.catalyst.expressions

    @staticmethod
    def kind(node) -> str:
        return node.getClass().getSimpleName()

    @staticmethod
    def items(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def seq(self, items: list):
        return self.jvm.PythonUtils.toSeq(items)

    def analysed(self, df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    def frame(self, plan) -> DataFrame:
        return DataFrame(getattr(self.jvm.org.apache.spark.sql.classic, "Dataset").ofRows(self.spark._jsparkSession, plan), self.spark)

    def column(self, expression) -> Column:
        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def expression(self, column: Column):
        return self.spark._jsparkSession.expression(column._jc)

    def data_type(self, expression) -> DataType:
        return _parse_datatype_json_string(expression.dataType().json())

    def id(self, named) -> int:
        return named.exprId().id()

    def ids(self, plan) -> list[int]:
        return [self.id(a) for a in self.items(plan.output())]

    def attribute(self, df: DataFrame, name: str):
        """The output attribute of a generated name."""
        return next(a for a in self.items(self.analysed(df).output()) if a.name() == name)

    def alias(self, expression, name: str, expr_id=None):
        e = self.expressions
        none = self.jvm.scala.Option.empty()
        return e.Alias(expression, name, expr_id or e.NamedExpression.newExprId(), self.seq([]), none, self.seq([]))

    def project(self, items: list, child) -> DataFrame:
        return self.frame(self.logical.Project(self.seq(items), child))

    def generate_outer(self, node, child) -> DataFrame:
        return self.frame(self.logical.Generate(node.generator(), self.seq([]), True, node.qualifier(), node.generatorOutput(), child))

    def aggregate(self, grouping: list, items: list, child) -> DataFrame:
        return self.frame(self.logical.Aggregate(self.seq(grouping), self.seq(items), child, self.jvm.scala.Option.empty()))

    def join(self, node, left, right, how, condition) -> DataFrame:
        types = self.jvm.org.apache.spark.sql.catalyst.plans
        kind = types.JoinType.apply(how) if isinstance(how, str) else how
        option = self.jvm.scala.Option.apply(condition) if condition is not None else self.jvm.scala.Option.empty()
        return self.frame(self.logical.Join(left, right, kind, option, node.hint()))

    def existence(self, name: str):
        """A join type that adds whether a row has a match, and that flag."""
        types = self.jvm.org.apache.spark.sql.types
        e = self.expressions
        flag = e.AttributeReference(name, types.DataTypes.BooleanType, False, types.Metadata.empty(), e.NamedExpression.newExprId(), self.seq([]))
        return self.jvm.org.apache.spark.sql.catalyst.plans.ExistenceJoin(flag), flag

    def set_operation(self, node, how: str):
        """An intersection or difference as the distinct rows of its left side that a join with the right one keeps."""
        left, right = self.items(node.children())
        e, option = self.expressions, self.jvm.scala.Option
        condition = None
        for x, y in zip(self.items(left.output()), self.items(right.output()), strict=True):
            same = e.EqualNullSafe(x, y)
            condition = same if condition is None else e.And(condition, same)
        kind = self.jvm.org.apache.spark.sql.catalyst.plans.JoinType.apply(how)
        hint = getattr(getattr(self.logical, "JoinHint$"), "MODULE$").NONE()
        return self.logical.Distinct(self.logical.Join(left, right, kind, option.apply(condition), hint))

    def expand(self, lists: list[list], outputs: list, df: DataFrame, names: list[str]) -> DataFrame:
        """The rows that each list of expressions makes of df, with the columns of these names as they are."""
        more = [self.attribute(df, n) for n in names]
        return self.frame(self.logical.Expand(self.seq([self.seq([*p, *more]) for p in lists]), self.seq([*outputs, *more]), self.analysed(df)))

    def union(self, plans: list) -> DataFrame:
        return self.frame(self.logical.Union(self.seq(plans), False, False))

    def replaced(self, node, child) -> DataFrame:
        return self.frame(node.withNewChildren(self.seq([child])))
