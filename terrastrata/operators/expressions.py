"""Band-math expressions: checked word by word, then handed to Spark as an expression.

Only names, numbers, operators and listed functions pass, so request text never reaches the SQL
expression parser unchecked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|<=|>=|==|!=|&&|\|\||[-+*/%()<>!?:,]))")
FUNCTIONS = frozenset("abs ceil exp floor greatest least log log10 pow round sqrt".split())
#: Limits of one request.
MAX_VARIABLES, MAX_WORDS, MAX_EXPRESSIONS = 10, 200, 10
_SIGNS = (" - ", " + ", " NOT ")
_SQL = {"&&": " AND ", "||": " OR ", "!": " NOT ", "==": " = "}


@dataclass(frozen=True)
class Expression:
    """A checked expression: its output name, SQL text and variables."""

    name: str
    sql: str
    variables: tuple[str, ...]

    @property
    def bare(self) -> bool:
        """Whether it is just a variable, so that nothing needs evaluating."""
        return self.sql == f"`{self.variables[0]}`" if len(self.variables) == 1 else False

    def column(self) -> Column:
        return F.expr(self.sql)


def _words(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    if len(out) > MAX_WORDS:
        raise ValueError("the expression is too long")
    return out


def _top(words: list[tuple[str, str]], wanted: str, start: int = 0) -> int:
    """Place of an operator outside all brackets, or -1."""
    depth = 0
    for i in range(start, len(words)):
        w = words[i][1]
        depth += (w == "(") - (w == ")")
        if depth == 0 and w == wanted:
            return i
    return -1


def _sql(words: list[tuple[str, str]]) -> str:
    """SQL text; ``a ? b : c`` becomes IF, ``a ** b`` POW."""
    q = _top(words, "?")
    if q >= 0:
        nested, c = 0, -1
        for i in range(q + 1, len(words)):
            nested += (words[i][1] == "?") - (words[i][1] == ":")
            if nested < 0:
                c = i
                break
        if c < 0:
            raise ValueError("a choice without ':'")
        return f"IF({_sql(words[:q])}, {_sql(words[q + 1 : c])}, {_sql(words[c + 1 :])})"
    parts, i = [], 0  # operands (a call or a bracket is one) and operators
    while i < len(words):
        kind, w = words[i]
        call = kind == "name" and i + 1 < len(words) and words[i + 1][1] == "("
        if w == "(" or call:
            first = i + 2 if call else i + 1
            depth, j = 1, first
            while j < len(words) and depth:
                depth += (words[j][1] == "(") - (words[j][1] == ")")
                j += 1
            if depth:
                raise ValueError("brackets don't match")
            parts.append(f"{w if call else ''}({_arguments(words[first : j - 1])})")
            i = j
        elif w == ")":
            raise ValueError("brackets don't match")
        else:
            parts.append(w if kind == "number" else f"`{w}`" if kind == "name" else _SQL.get(w, f" {w} "))
            i += 1
    for i in range(len(parts) - 2, 0, -1):  # powers bind to the right, and more than a sign before them
        if parts[i] == " ** ":
            end = i + 1
            while end < len(parts) - 1 and parts[end] in _SIGNS:
                end += 1
            exponent = "".join(parts[i + 1 : end + 1])
            parts[i - 1 : end + 1] = [f"POW({parts[i - 1]}, {exponent})"]
    return "".join(parts)


def _arguments(words: list[tuple[str, str]]) -> str:
    comma = _top(words, ",")
    return _sql(words) if comma < 0 else f"{_sql(words[:comma])}, {_arguments(words[comma + 1 :])}"


def parse(text: str, allowed: list[str] | None = None) -> Expression:
    """Check ``name = expression`` or a bare expression; ``allowed`` lists the variables there are."""
    name, _, body = text.partition("=") if re.match(r"\s*[A-Za-z_]\w*\s*=(?!=)", text) else (text, "", text)
    words = _words(body)
    if not words:
        raise ValueError("an empty expression")
    names = []
    for i, (kind, w) in enumerate(words):
        if kind != "name":
            continue
        if i + 1 < len(words) and words[i + 1][1] == "(":
            if w.lower() not in FUNCTIONS:
                raise ValueError(f"no function {w}")
        elif w not in names:
            names.append(w)
    if len(names) > MAX_VARIABLES:
        raise ValueError("too many variables")
    if allowed is not None and (unknown := [n for n in names if n not in allowed]):
        raise ValueError(f"no variable {', '.join(unknown)}")
    return Expression(name.strip(), _sql(words), tuple(names))


def parse_all(texts: list[str], allowed: list[str] | None = None) -> list[Expression]:
    """Several expressions; their variables are the union, in order of appearance."""
    if len(texts) > MAX_EXPRESSIONS:
        raise ValueError("too many expressions")
    return [parse(t, allowed) for t in texts]
