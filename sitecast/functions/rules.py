"""Rule expressions as data: Spark SQL text, checked against a whitelist before any job runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTIONS = ("abs", "cos", "exp", "greatest", "least", "ln", "power", "radians", "sin", "sqrt", "clamp")
WORDS = ("and", "or", "not", "null", "is", "true", "false", "case", "when", "then", "else", "end", "between", "in")


class RuleError(ValueError):
    """A rule that names something unknown."""


def check(expression: str, names: list[str]) -> None:
    """Raise RuleError for a function outside the whitelist, an unknown name, or a character that no rule needs."""
    if not re.fullmatch(r"[\w\s.+\-*/%()<>=!,']*", expression):
        raise RuleError(f"not a rule: {expression}")
    for m in re.finditer(r"(?<![\w.'])([A-Za-z_]\w*)(\s*\()?", re.sub(r"'[^']*'", "", expression)):
        word = m[1].lower()
        if m[2] and word not in WORDS and word not in FUNCTIONS:
            raise RuleError(f"unknown function {m[1]}")
        if not m[2] and word not in WORDS and m[1] not in names:
            raise RuleError(f"unknown name {m[1]}")


def apply_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``df`` with a column for each rule, in order; a rule may use the columns of those before it.

    Every rule is checked before the first is applied.  ``clamp`` is expanded here: Spark has no such function.
    """
    names = list(df.columns)
    expanded = {}
    for name, expression in rules.items():
        check(expression, names)
        expanded[name] = _expand(expression)
        names.append(name)
    for name, expression in expanded.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def first_match(df: DataFrame, output: str, rules: dict[str, str]) -> DataFrame:
    """A column with the name of the first predicate that holds, in order."""
    out = F
    for name, predicate in rules.items():
        check(predicate, df.columns)
        out = out.when(F.expr(_expand(predicate)), name)
    return df.withColumn(output, out)


def _expand(expression: str) -> str:
    """clamp(x, lo, hi), innermost first, as a null-safe CASE."""
    while found := list(re.finditer(r"\bclamp\s*\(", expression, re.IGNORECASE)):
        start = found[-1]
        depth, at, cuts = 1, start.end(), []
        while depth:
            c = expression[at]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                cuts.append(at)
            at += 1
        if len(cuts) != 2:
            raise RuleError(f"clamp needs three arguments: {expression}")
        x, lo, hi = expression[start.end() : cuts[0]], expression[cuts[0] + 1 : cuts[1]], expression[cuts[1] + 1 : at - 1]
        expression = f"{expression[: start.start()]}(case when ({x}) is not null then greatest({lo}, least({hi}, {x})) end){expression[at:]}"
    return expression
