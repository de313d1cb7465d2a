"""Compile syntax trees to Spark columns.

Two treatments of null and of operands whose types don't match:

``sql``     three-valued logic: a comparison with null is neither true nor
            false and its row is dropped; a literal takes the column's type.
``legacy``  two-valued logic: null, NaN and operands of different types count
            as equal, so ``=``, ``<=`` and ``>=`` hold and the others don't.

Both come out as built-in expressions, so filters reach the scan.  ``= NULL``
and ``!= NULL`` test for null in either mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold_ascii
from .predicate import (
    STRING_TESTS,
    Among,
    Between,
    Comparison,
    Literal,
    Logical,
    Negation,
    Node,
    PredicateError,
    Property,
    fold_equalities,
    joined,
)

MODES = ("sql", "legacy")
_TRUE_IF_EQUAL = {"=", "<=", ">="}


def family(kind: T.DataType | None) -> str:
    """int, float, string, bool, null or other: types of different families don't match in ``legacy`` mode."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(kind, T.DoubleType):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "null" if kind is None or isinstance(kind, T.NullType) else "other"


class Compiler:
    """Compiles predicates over a table's schema; ``aliases`` maps other names of columns to their own."""

    def __init__(self, schema: T.StructType, nulls: str = "sql", aliases: dict[str, str] | None = None):
        if nulls not in MODES:
            raise ValueError(f"nulls must be one of {MODES}")
        self.schema, self.nulls, self.aliases = schema, nulls, aliases or {}

    def column(self, node: Node) -> Column:
        """The predicate as a boolean column (``sql``: it may be null, which a filter drops)."""
        try:
            return self._truth(fold_equalities(node))
        except RecursionError:
            raise PredicateError("a predicate is nested too deeply") from None

    def _field(self, name: str) -> tuple[Column, T.DataType]:
        path = self.aliases.get(name, name)
        kind: T.DataType = self.schema
        if path in self.schema.names:
            return F.col(f"`{path}`"), self.schema[path].dataType
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise PredicateError(f"no property {name!r}")
            kind = kind[part].dataType
        return F.col(".".join(f"`{p}`" for p in path.split("."))), kind

    def _operand(self, node: Node) -> tuple[Column, T.DataType | None]:
        if isinstance(node, Property):
            return self._field(node.name)
        if isinstance(node, Literal):
            kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
            return F.lit(node.value), kinds.get(type(node.value))
        return self._truth(node), T.BooleanType()

    def _truth(self, node: Node) -> Column:
        if isinstance(node, Logical):
            a, b = self._truth(node.left), self._truth(node.right)
            return a & b if node.op == "AND" else a | b
        if isinstance(node, Negation):
            return ~self._truth(node.operand)
        if isinstance(node, Comparison):
            return self._compare(node)
        if isinstance(node, Between):
            return self._compare(Comparison(">=", node.left, node.low)) & self._compare(Comparison("<=", node.left, node.high))
        if isinstance(node, Among):
            return self._among(node)
        column, kind = self._operand(node)
        return F.coalesce(column, F.lit(False)) if isinstance(kind, T.BooleanType) else F.lit(False)

    def _among(self, node: Among) -> Column:
        column, kind = self._operand(node.left)
        if self.nulls == "legacy":
            return self._truth(joined("OR", [Comparison("=", node.left, v) for v in node.values]))
        for v in node.values:
            self._comparable(node.left, kind, v, self._operand(v)[1])
        return column.isin(*[self._fit(v, kind) for v in node.values])

    @staticmethod
    def _comparable(left: Node, kind_left: T.DataType | None, right: Node, kind_right: T.DataType | None) -> None:
        pair = {family(kind_left), family(kind_right)}
        if len(pair) == 2 and not pair & {"other", "null"} and pair != {"int", "float"}:
            raise PredicateError(f"{left} and {right} can't be compared")

    @staticmethod
    def _fit(node: Literal, kind: T.DataType | None) -> Column:
        """A literal in the type of the column beside it, where that loses nothing."""
        value = node.value
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
            return F.lit(value).cast(kind)
        if isinstance(kind, T.DecimalType) and isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.lit(str(value)).cast(T.DecimalType(38, 18))
        if isinstance(kind, T.BinaryType) and isinstance(value, str):
            return F.lit(value.encode())
        return F.lit(value)

    def _compare(self, node: Comparison) -> Column:
        (a, kind_a), (b, kind_b) = self._operand(node.left), self._operand(node.right)
        if node.op in ("=", "!="):  # with the literal NULL
            for x, y in ((node.left, b), (node.right, a)):
                if isinstance(x, Literal) and x.value is None:
                    return y.isNull() if node.op == "=" else y.isNotNull()
        if isinstance(node.right, Literal):
            b = self._fit(node.right, kind_a)
        if isinstance(node.left, Literal):
            a = self._fit(node.left, kind_b)
        fa, fb = family(kind_a), family(kind_b)
        if node.op in STRING_TESTS:
            if fa != "string" or fb not in ("string", "null"):
                if self.nulls == "legacy":
                    return F.lit(False)
                raise PredicateError(f"{node.op} compares strings")
            return self._string(node, a, b)
        if self.nulls == "legacy":
            return self._legacy(node.op, a, b, fa, fb)
        self._comparable(node.left, kind_a, node.right, kind_b)
        return self._apply(node.op, a, b)

    @staticmethod
    def _apply(op: str, a: Column, b: Column) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _legacy(self, op: str, a: Column, b: Column, fa: str, fb: str) -> Column:
        alike = F.lit(op in _TRUE_IF_EQUAL)
        if fa != fb or fa in ("other", "null"):
            return alike
        test = self._apply(op, a, b)
        if fa == "float":
            test = F.when(F.isnan(a) | F.isnan(b), alike).otherwise(test)
        return F.coalesce(test, alike)

    def _string(self, node: Comparison, a: Column, b: Column) -> Column:
        if node.ignore_case:
            a, b = fold_ascii(a), fold_ascii(b)
        if node.op == "LIKE":
            if not isinstance(node.right, Literal):
                raise PredicateError("LIKE takes a string literal")
            pattern = node.right.value
            test = a.like("".join(c.lower() if "A" <= c <= "Z" else c for c in pattern) if node.ignore_case else pattern)
        else:
            test = {"CONTAINS": F.contains, "BEGINSWITH": F.startswith, "ENDSWITH": F.endswith}[node.op](a, b)
        return F.coalesce(test, F.lit(False)) if self.nulls == "legacy" else test
