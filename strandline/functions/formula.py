"""Arithmetic over series A to Z, for Columns and for numbers."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.contract import MAX_FORMULA, InvalidQuery

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z])(?![A-Za-z0-9])|([-+*/()]))")
MAX_TOKENS, MAX_DEPTH = 500, 32


def tokens(formula: str) -> list[str]:
    if not formula.strip() or len(formula.encode()) > MAX_FORMULA:
        raise InvalidQuery("a formula has 1 to 1,000 bytes")
    out, at, end = [], 0, len(formula.rstrip())
    while at < end:
        m = TOKEN.match(formula, at)
        if not m:
            raise InvalidQuery(f"unexpected {formula[at:at + 10]!r} in the formula")
        out.append((m[1] or (m[2] or "").upper() or m[3]))
        at = m.end()
    if len(out) > MAX_TOKENS:
        raise InvalidQuery("the formula is too long")
    return out


def parse(formula: str, n_series: int) -> Any:
    """A tree: numbers, letters, ('neg', x) and (operator, x, y)."""
    rest = tokens(formula)[::-1]

    def peek() -> str:
        return rest[-1] if rest else ""

    def expression(depth: int, level: int = 0) -> Any:
        if depth > MAX_DEPTH:
            raise InvalidQuery("the formula is nested too deeply")
        if level == 2:
            return operand(depth + 1)
        tree = expression(depth + 1, level + 1)
        while peek() and peek() in ("+-", "*/")[level]:
            tree = (rest.pop(), tree, expression(depth + 1, level + 1))
        return tree

    def operand(depth: int) -> Any:
        if depth > MAX_DEPTH:
            raise InvalidQuery("the formula is nested too deeply")
        if not rest:
            raise InvalidQuery("the formula ends too early")
        token = rest.pop()
        if token in "+-":
            inner = operand(depth + 1)
            return ("neg", inner) if token == "-" else inner
        if token == "(":
            inner = expression(depth + 1)
            if not rest or rest.pop() != ")":
                raise InvalidQuery("a bracket is not closed")
            return inner
        if token.isalpha():
            if ord(token) - 65 >= n_series:
                raise InvalidQuery(f"there is no series {token}")
            return token
        if token in "*/)":
            raise InvalidQuery(f"unexpected {token!r} in the formula")
        return float(token)

    tree = expression(0)
    if rest:
        raise InvalidQuery(f"unexpected {rest[-1]!r} in the formula")
    return tree


def _fold(tree: Any, leaf: Callable, negate: Callable, binary: Callable) -> Any:
    if not isinstance(tree, tuple):
        return leaf(tree)
    parts = [_fold(t, leaf, negate, binary) for t in tree[1:]]
    return negate(*parts) if tree[0] == "neg" else binary(tree[0], *parts)


def column(formula: str, series: list[Column]) -> Column:
    """The formula over columns of doubles: division by zero gives 0, and so does any result that
    is no finite number."""

    def binary(op: str, a: Column, b: Column) -> Column:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b == 0, F.lit(0.0)).otherwise(a / b)}[op]()

    result = _fold(parse(formula, len(series)), lambda x: series[ord(x) - 65] if isinstance(x, str) else F.lit(x), lambda a: -a, binary)
    finite = ~(F.isnan(result) | (F.abs(result) == float("inf")))
    return F.when(finite, result).otherwise(F.lit(0.0))


def value(formula: str, series: list[float]) -> float:
    """The formula over numbers."""

    def binary(op: str, a: float, b: float) -> float:
        return {"+": a + b, "-": a - b, "*": a * b}[op] if op != "/" else (0.0 if b == 0 else a / b)

    result = _fold(parse(formula, len(series)), lambda x: float(series[ord(x) - 65]) if isinstance(x, str) else x, lambda a: -a, binary)
    return result if abs(result) < float("inf") else 0.0
