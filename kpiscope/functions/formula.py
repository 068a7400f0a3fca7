"""Contract formulas: arithmetic over declared columns, compiled to a ``Column``.

The text is parsed by Python's ``ast`` and walked against a whitelist; it is never evaluated,
and never handed to Spark as SQL text.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The formula uses syntax or a name that the contract does not allow."""


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),  # zero divisors are unknown
}
_UNARY: dict[type, Callable[[Column], Column]] = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a}


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {text!r}") from e


def names(text: str) -> list[str]:
    return sorted({n.id for n in ast.walk(_tree(text)) if isinstance(n, ast.Name)})


def compile_formula(text: str, declared: Iterable[str]) -> Column:
    known = set(declared)

    def walk(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool()) | ast.Constant(value=str()) | ast.Constant(value=None):
                raise FormulaError(f"only numbers may stand in a formula: {text!r}")
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name):
                if name not in known:
                    raise FormulaError(f"undeclared name {name!r} in {text!r}")
                return F.col(name)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                return _UNARY[type(op)](walk(a))
        raise FormulaError(f"{type(node).__name__} is not allowed in {text!r}")

    return walk(_tree(text))


def apply_formula(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``; every column of the formula must be there."""
    missing = [n for n in names(text) if n not in df.columns]
    if missing:
        raise FormulaError(f"{out} needs the columns {missing}")
    return df.withColumn(out, compile_formula(text, df.columns))
