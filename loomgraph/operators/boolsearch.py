"""Boolean search language compiled to a Column: ``+`` is OR, ``*`` or a blank AND, ``!`` NOT, ``"..."`` a phrase, parentheses.

A query is put into postfix form by the strength of its operators, and a postfix
form is evaluated over any algebra: over Columns it is the search condition, over
truth values it tells whether the query asks for anything at all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The operators, weakest first.
STRENGTH = {"+": 1, "*": 2, "!": 3}
#: Fixed value: an ASCII term must begin a word.
WORD_START = r"(?<![a-z0-9])"
_LEXEME = re.compile(r'"(?P<phrase>[^"]*)"|(?P<op>[()+*!])|(?P<term>[^\s()+*!"]+)|(?P<bad>\S)')


class QueryError(ValueError):
    """A query that is empty, unbalanced, or has nothing but NOT."""


Postfix = list[tuple[str, str]]


def parse(query: str) -> Postfix:
    """Operands ("term" | "phrase", text) and operators ("op", sign) in postfix order; AND binds tighter than OR."""
    out: Postfix = []
    held: list[str] = []
    operand_due = True

    def release(least: int) -> None:
        while held and held[-1] != "(" and STRENGTH[held[-1]] >= least:
            out.append(("op", held.pop()))

    for m in _LEXEME.finditer(query):
        kind, text = m.lastgroup, m[m.lastgroup].strip()
        if kind == "bad":
            raise QueryError(f"cannot read {query[m.start():]!r}")
        if not operand_due and (kind != "op" or text in "(!"):  # side by side means AND
            release(STRENGTH["*"])
            held.append("*")
            operand_due = True
        if kind != "op":
            if not text:
                raise QueryError("an empty phrase")
            out.append((kind, text))
            operand_due = False
        elif text in "(!":
            held.append(text)
        elif operand_due:
            raise QueryError(f"{text!r} stands where a term is due")
        elif text == ")":
            release(0)
            if not held:
                raise QueryError("a parenthesis is not opened")
            held.pop()
        else:
            release(STRENGTH[text])
            held.append(text)
            operand_due = True
    if operand_due:
        raise QueryError("the query ends too early")
    release(0)
    if held:
        raise QueryError("a parenthesis is not closed")
    if not evaluate(out, lambda kind, text: True, {"+": lambda a, b: a and b, "*": lambda a, b: a or b, "!": lambda a: False}):
        raise QueryError("a query needs a term that is not negated")
    return out


def evaluate(query: Postfix, operand: Callable, operators: dict[str, Callable]):
    """The value of a postfix form, with ``operand`` for its leaves."""
    stack: list = []
    for kind, text in query:
        if kind != "op":
            stack.append(operand(kind, text))
        elif text == "!":
            stack.append(operators["!"](stack.pop()))
        else:
            right = stack.pop()
            stack.append(operators[text](stack.pop(), right))
    return stack.pop()


def matches(query: Postfix, columns: list[Column]) -> Column:
    """The condition on any of ``columns``: a phrase or a term beyond ASCII is a substring, an ASCII term begins a word. Null columns hold nothing."""

    def leaf(kind: str, text: str) -> Column:
        said = " ".join(unicodedata.normalize("NFKC", text).lower().split())
        word = kind == "term" and said.isascii()
        each = [F.lower(c).rlike(WORD_START + re.escape(said)) if word else F.contains(F.lower(c), F.lit(said)) for c in columns]
        return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in each))

    return evaluate(query, leaf, {"+": lambda a, b: a | b, "*": lambda a, b: a & b, "!": lambda a: ~a})


def search(docs: DataFrame, query: str, fields: dict[str, str], use: str = "TI AB CL", fallback: str | None = None, exclude: DataFrame | None = None, codes: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id) of the documents that match ``query`` in the fields ``use`` names.

    ``fields`` maps field names to columns; the field CL falls back to the column
    ``fallback`` (independent claims) where it is blank. ``exclude`` (id) holds
    documents that never come out, ``codes`` (id) those that a code filter lets
    through (``codes_within``).
    """
    at = {k: F.col(c) for k, c in fields.items()}
    if fallback and "CL" in at:
        at["CL"] = F.when(F.length(F.trim(at["CL"])) > 0, at["CL"]).otherwise(F.col(fallback))
    found = docs.where(matches(parse(query), [at[f] for f in use.split()])).select(id_col)
    if codes is not None:
        found = found.join(codes.select(id_col).distinct(), id_col, "left_semi")
    return found if exclude is None else found.join(exclude.select(id_col), id_col, "left_anti")


def codes_within(held: DataFrame, expanded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id) of documents holding (id, code) a code whose subclass, main group or whole is among ``expanded`` (code)."""
    keys = F.array_distinct(F.array(F.substring_index("code", " ", 1), F.substring_index("code", "/", 1), F.col("code")))
    return held.select(id_col, F.explode(keys).alias("code")).join(expanded.select("code").distinct(), "code", "left_semi").select(id_col).distinct()
