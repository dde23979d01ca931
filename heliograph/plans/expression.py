"""Set expressions over named ternary sets: `|` `&` `^` `\\` `!` `~` `%`, parentheses and $functions.

An expression is parsed to a tree and planned as one column over a wide table of
the sets it names, so however long it is, its sets meet in a single shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sets

_TOKEN = re.compile(r"\s*(\$\w+|[A-Za-z_]\w*|[|&^\\!~%(),]|-?\d+|'[^']*')")
_BINARY = {"|": (1, sets.t_or), "^": (2, sets.t_xor), "\\": (3, sets.t_minus), "&": (4, sets.t_and)}


def tokenise(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r} at {at}")
        out.append(m[1])
        at = m.end()
    return out


class Parser:
    """Precedence climbing; unary `~` (not), `!` (0 to -1) and `%` (-1 to 1) bind tightest."""

    def __init__(self, text: str, functions: dict[str, Callable[..., Column]] | None = None):
        self.tokens, self.at, self.names = tokenise(text), 0, []
        self.functions = functions or {}
        self.column = self.binary(1)
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def binary(self, least: int) -> Column:
        left = self.unary()
        while (op := _BINARY.get(self.peek() or "")) and op[0] >= least:
            self.next()
            left = op[1](left, self.binary(op[0] + 1))
        return left

    def unary(self) -> Column:
        t = self.next()
        if t == "~":
            return -self.unary()
        if t == "!":
            x = self.unary()
            return F.when(x == 0, -1).otherwise(x)
        if t == "%":
            x = self.unary()
            return F.when(x == -1, 1).otherwise(x)
        if t == "(":
            x = self.binary(1)
            if self.next() != ")":
                raise ValueError("a parenthesis isn't closed")
            return x
        if t.startswith("$"):
            if t not in self.functions:
                raise ValueError(f"no function is named {t}")
            args = []
            if self.next() != "(":
                raise ValueError(f"{t} needs arguments in parentheses")
            while (a := self.next()) != ")":
                if a != ",":
                    args.append(a.strip("'"))
            return F.when(self.functions[t](*args), 1).otherwise(0)
        if re.fullmatch(r"[A-Za-z_]\w*", t):
            if t not in self.names:
                self.names.append(t)
            return F.col(t)
        raise ValueError(f"unexpected {t!r}")


#: Predicates on the columns of an object table that was joined beforehand.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "$indexrange": lambda lo, hi: F.col("object_idx").between(int(lo), int(hi)),
    "$eye": lambda *idx: F.col("object_idx").isin([int(i) for i in idx]),
    "$split": lambda part, of: F.pmod("object_idx", F.lit(int(of))) == int(part),
    "$labelrange": lambda lo, hi: F.col("label").between(lo, hi),
    "$regexp": lambda pattern: F.col("label").rlike(pattern),
    "$type": lambda mask: F.col("type").bitwiseAND(int(mask)) == int(mask),
    "$nchildren": lambda n: F.col("n_children") >= int(n),
    "$frames": lambda n: F.col("frames") >= int(n),
    "$nkeys": lambda n: F.col("n_keys") >= int(n),
    "$head": lambda n: F.col("rank") <= int(n),
    "$date": lambda lo, hi: F.to_date("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")),
    "$data": lambda i, op, value: {"<": F.element_at("vec", int(i) + 1) < float(value), ">": F.element_at("vec", int(i) + 1) > float(value), "=": F.element_at("vec", int(i) + 1) == float(value)}[op],
    "$text": lambda word: F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), word.lower()),
    "$sql": lambda condition: F.expr(condition),
    "$auxid": lambda *ids: F.col("aux_id").isin(list(ids)),
    "$masters": lambda: F.col("master_idx") == F.col("object_idx"),
    "$duplicates": lambda: F.col("master_idx") != F.col("object_idx"),
    "$children": lambda *idx: F.col("parent_idx").isin([int(i) for i in idx]),
    "$middleframe": lambda: F.col("frame") == F.floor((F.col("frames") - 1) / 2),
}


def evaluate(text: str, named: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """named: (name, object_idx, v). objects: all objects, with the columns that $functions look at;
    without it, those that a named set mentions."""
    p = Parser(text, FUNCTIONS)
    w = sets.wide(named, p.names) if p.names else None
    if objects is not None:
        w = objects.join(w, "object_idx", "left").fillna(0, p.names) if w is not None else objects
    if w is None:
        raise ValueError("an expression without sets needs a table of objects")
    return w.select("object_idx", p.column.cast("int").alias("v"))
