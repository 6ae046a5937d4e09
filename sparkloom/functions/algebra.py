"""Arithmetic text over columns: Python's own parser gives the tree, an allow-list of nodes turns it into columns."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Pow: lambda a, b: F.when((a == 0) & (b < 0), F.lit(None)).otherwise(F.pow(a, b)),
}
SIGNS = {ast.UAdd: lambda a: a, ast.USub: lambda a: -a}


def expression(formula: str, variables: dict[str, str | float]) -> Column:
    """formula over + - * / **, signs, brackets, numbers and named variables, each a column name or a number, as doubles.
    Precedence is Python's. An unknown name or anything else in the text is an error. Division by zero gives null."""

    def column(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in PAIRS:
            return PAIRS[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in SIGNS:
            return SIGNS[type(node.op)](column(node.operand))
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in variables:
                raise ValueError(f"unknown variable: {node.id}")
            value = variables[node.id]
            return F.col(f"`{value}`").cast("double") if isinstance(value, str) else F.lit(float(value))
        raise ValueError(f"not an arithmetic expression: {formula!r}")

    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not an arithmetic expression: {formula!r}") from error
    return column(tree.body)


def solve(left: str, right: str, unknown: str, variables: dict[str, str | float]) -> Column:
    """The value of `unknown` for which left = right, linear in it: two evaluations give slope and offset. Null where the
    slope is below 1e-12."""
    def at(x: float) -> Column:
        return expression(left, variables | {unknown: x}) - expression(right, variables | {unknown: x})

    offset = at(0.0)
    slope = at(1.0) - offset
    return F.when(F.abs(slope) >= 1e-12, -offset / slope)
