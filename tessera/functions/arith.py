"""Scalar expressions: literals, columns, unary minus and the four operations.

Standard precedence is the parser's matter; here a tree becomes a Column. Division of two
integers truncates, as does the dialect's; any division by zero gives NULL, for a failing
row should not end a query over terabytes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class Literal:
    value: int | float | str
    text: str = ""


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Negated:
    of: Expression


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expression
    right: Expression


Expression = Literal | Name | Negated | Binary


def names_in(e: Expression) -> set[str]:
    if isinstance(e, Name):
        return {e.name}
    if isinstance(e, Negated):
        return names_in(e.of)
    return names_in(e.left) | names_in(e.right) if isinstance(e, Binary) else set()


def is_integer(e: Expression, types: Mapping[str, T.DataType]) -> bool:
    if isinstance(e, Literal):
        return isinstance(e.value, int)
    if isinstance(e, Name):
        return isinstance(types[e.name], T.IntegralType)
    if isinstance(e, Negated):
        return is_integer(e.of, types)
    return is_integer(e.left, types) and is_integer(e.right, types)


def has_division(e: Expression) -> bool:
    if isinstance(e, Negated):
        return has_division(e.of)
    return isinstance(e, Binary) and (e.op == "/" or has_division(e.left) or has_division(e.right))


def compiled(e: Expression, types: Mapping[str, T.DataType], scales: Mapping[str, tuple[int, int]] | None = None) -> Column:
    """The Column of an expression. With ``scales`` (precision and scale by column) its doubles
    are taken as the decimals that they stand for, so that sums don't depend on their order."""
    if isinstance(e, Literal):
        if scales is not None and isinstance(e.value, float):
            return F.lit(Decimal(e.text or repr(e.value)))
        return F.lit(e.value)
    if isinstance(e, Name):
        column = F.col(e.name)
        return column.cast(T.DecimalType(*scales[e.name])) if scales and e.name in scales else column
    if isinstance(e, Negated):
        return -compiled(e.of, types, scales)
    left, right = compiled(e.left, types, scales), compiled(e.right, types, scales)
    if e.op == "+":
        return left + right
    if e.op == "-":
        return left - right
    if e.op == "*":
        return left * right
    if is_integer(e, types):
        # On positive and negative operands alike the quotient is cut towards zero.
        return _integer_quotient(left, right)
    return F.try_divide(left.cast("double"), right.cast("double"))


def _integer_quotient(left: Column, right: Column) -> Column:
    left, right = left.cast("long"), F.nullif(right.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", left, right)


def exact_scales(e: Expression, types: Mapping[str, T.DataType], scales: Mapping[str, tuple[int, int]]) -> dict[str, tuple[int, int]] | None:
    """Scales for an exact sum of ``e``, if all its doubles have one and nothing is divided."""
    doubles = {n for n in names_in(e) if isinstance(types[n], (T.DoubleType, T.FloatType))}
    if not doubles or has_division(e) or not doubles <= scales.keys():
        return None
    return {n: scales[n] for n in doubles}
