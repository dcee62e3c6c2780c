"""Expressions over named parameters, compiled to Columns.

The text is parsed once on the driver; only what a whitelist names is accepted. A value is a struct(kind, num, str, bool): a
name is read as what its context asks for, so that a string never equals a number. Anything undefined (a missing value, a
division by zero, a root of a negative number) is null, which the evaluation turns into "not evaluable".
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """The text is no expression of the language."""


@dataclass
class Term:
    col: Column
    kind: str  # num, str, bool, or any for a name


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "min": (2, 9, lambda *a: _strict(F.least(*a), *a)),
    "max": (2, 9, lambda *a: _strict(F.greatest(*a), *a)),
    "sum": (1, 9, lambda *a: sum(a[1:], a[0])),
    "abs": (1, 1, F.abs),
    "round": (1, 1, lambda x: F.bround(x, 0)),
    "pow": (2, 2, F.pow),
    "ceil": (1, 1, lambda x: F.ceil(x).cast("double")),
    "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "sqrt": (1, 1, lambda x: F.when(x >= 0, F.sqrt(x))),
}
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def _strict(out: Column, *args: Column) -> Column:
    """least and greatest pass over nulls; here one makes the result undefined."""
    ok = F.lit(True)
    for a in args:
        ok = ok & a.isNotNull()
    return F.when(ok, out)


def names(text: str) -> set[str]:
    """The parameters that the expression reads."""
    return {n.id for n in ast.walk(_parsed(text)) if isinstance(n, ast.Name)} - set(FUNCTIONS)


def _parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise RuleError(f"{text!r}: {e}") from None


def compile_rule(text: str, value: Callable[[str], Column]) -> Term:
    """value: name → struct(kind, num, str, bool), null where absent."""
    return _Compiler(value).term(_parsed(text))


def truth(t: Term) -> Column:
    if t.kind == "bool":
        return t.col
    if t.kind == "num":
        return t.col != 0
    if t.kind == "str":
        return t.col != ""
    return F.coalesce(t.col["bool"], t.col["num"] != 0, t.col["str"] != "")


def number(t: Term) -> Column:
    if t.kind == "num":
        return t.col
    if t.kind == "bool":
        return t.col.cast("double")
    if t.kind == "any":
        return F.coalesce(t.col["num"], t.col["bool"].cast("double"))
    raise RuleError("a number is wanted where a text stands")


class _Compiler:
    def __init__(self, value: Callable[[str], Column]):
        self.value = value

    def term(self, n: ast.expr) -> Term:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, bool):
                return Term(F.lit(n.value), "bool")
            if isinstance(n.value, int | float):
                return Term(F.lit(float(n.value)), "num")
            if isinstance(n.value, str):
                return Term(F.lit(n.value), "str")
        elif isinstance(n, ast.Name):
            if n.id in FUNCTIONS:
                raise RuleError(f"{n.id} is a function")
            return Term(self.value(n.id), "any")
        elif isinstance(n, ast.BoolOp):
            cols = [truth(self.term(x)) for x in n.values]
            out = cols[0]
            for c in cols[1:]:
                out = (out & c) if isinstance(n.op, ast.And) else (out | c)
            return Term(out, "bool")
        elif isinstance(n, ast.UnaryOp):
            x = self.term(n.operand)
            if isinstance(n.op, ast.Not):
                return Term(~truth(x), "bool")
            if isinstance(n.op, ast.USub):
                return Term(-number(x), "num")
            if isinstance(n.op, ast.UAdd):
                return Term(number(x), "num")
        elif isinstance(n, ast.Compare):
            left, out = self.term(n.left), None
            for op, right in zip(n.ops, n.comparators, strict=True):
                r = self.term(right)
                c = self.compared(left, op, r)
                out = c if out is None else out & c
                left = r
            return Term(out, "bool")
        elif isinstance(n, ast.BinOp):
            a, b = number(self.term(n.left)), number(self.term(n.right))
            if isinstance(n.op, ast.Add):
                return Term(a + b, "num")
            if isinstance(n.op, ast.Sub):
                return Term(a - b, "num")
            if isinstance(n.op, ast.Mult):
                return Term(a * b, "num")
            if isinstance(n.op, ast.Div):
                return Term(F.try_divide(a, b), "num")
            if isinstance(n.op, ast.Mod):  # the sign of the divisor, as in Python
                return Term(F.when(b != 0, a - b * F.floor(F.try_divide(a, b))), "num")
            if isinstance(n.op, ast.Pow):
                return Term(F.pow(a, b), "num")
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            if n.func.id not in FUNCTIONS:
                raise RuleError(f"unknown function {n.func.id}")
            least, most, f = FUNCTIONS[n.func.id]
            if not least <= len(n.args) <= most:
                raise RuleError(f"{n.func.id} with {len(n.args)} arguments")
            return Term(f(*[number(self.term(x)) for x in n.args]), "num")
        raise RuleError(f"{ast.dump(n)[:80]} is not allowed")

    def compared(self, a: Term, op: ast.cmpop, b: Term) -> Column:
        if type(op) not in _COMPARE:
            raise RuleError("comparison is not allowed")
        how = _COMPARE[type(op)]
        equality = isinstance(op, ast.Eq | ast.NotEq)
        differ = F.lit(isinstance(op, ast.NotEq))
        if a.kind == "str" or b.kind == "str":
            text = lambda t: t.col if t.kind == "str" else t.col["str"] if t.kind == "any" else None
            x, y = text(a), text(b)
            if x is None or y is None:  # a text and a number are never equal
                if equality:
                    return differ
                raise RuleError("a text is compared with a number")
            present = F.lit(True)
            for t in (a, b):
                if t.kind == "any":
                    present = present & t.col.isNotNull()
            same_kind = x.isNotNull() & y.isNotNull()
            return F.when(present, F.when(same_kind, getattr(x, how)(y)).otherwise(differ if equality else F.lit(None).cast("boolean")))
        if a.kind == b.kind == "any":
            both_text = a.col["str"].isNotNull() & b.col["str"].isNotNull()
            both_num = number(a).isNotNull() & number(b).isNotNull()
            out = F.when(both_text, getattr(a.col["str"], how)(b.col["str"])).when(both_num, getattr(number(a), how)(number(b)))
            return out.when(a.col.isNotNull() & b.col.isNotNull(), differ) if equality else out
        out = getattr(number(a), how)(number(b))
        for t in (a, b):
            if t.kind == "any" and equality:
                out = F.when(t.col["str"].isNotNull(), differ).otherwise(out)
        return out
