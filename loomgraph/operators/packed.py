"""Several values packed in one field: a parsing expression grammar over each text.

    text     <- bracket end  (its inside is read as a list)  /  list end
    list     <- item (sep item)*
    item     <- blank* (quoted / bracket &stop / bare / empty)
    quoted   <- '"' ('""' / !'"' .)* '"' &stop
    bracket  <- '[' (quoted' / bracket / ![\\[\\]] .)* ']'        quoted' is quoted without &stop
    bare     <- (!sep .)+
    sep      <- blank* [|;；、\\n\\r\\t]  /  blank* [,，] !ending  /  blank+ '/' &(blank / end)  /  '/' end
              / blank+ &code                                     (code fields only)
    ending   <- blank* legal (','? blank* legal)* remark? &stop   (names only)
    stop     <- sep / blank* end

The rules below are these, one combinator each; alternatives are tried in order and
a failed one gives its input back. A ``quoted`` that does not stop is undone and read
as ``bare`` from the quotation mark on, and so is a ``bracket`` without its partner;
both raise an error flag. A comma before a legal form is kept only where the form ends
the value: "A, Inc." is one value, "A, A/S B" are two.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.keys import has_value

#: Legal forms of companies.
LEGAL_FORMS = ("Ltd", "Limited", "Inc", "Incorporated", "LLC", "L.L.C", "LLP", "L.P", "LP", "Corp", "Corporation", "Co", "Company", "GmbH", "AG", "KG", "SE", "S.A", "SA", "S.A.S", "SAS", "S.p.A", "S.r.l", "B.V", "BV", "N.V", "NV", "A/S", "AB", "Oy", "PLC", "Pte", "Pty", "K.K", "KK")

#: What a rule gives: the place after it and its value, or None where it fails.
Rule = Callable[[str, int], tuple[int, object] | None]


def rx(pattern: str, group: int = 0) -> Rule:
    """A terminal."""
    p = re.compile(pattern, re.I | re.S)

    def rule(t: str, i: int):
        m = p.match(t, i)
        return (m.end(), m[group]) if m else None

    return rule


def seq(*rules: Rule) -> Rule:
    """All in a row; the value is the list of their values."""

    def rule(t: str, i: int):
        out = []
        for r in rules:
            got = r(t, i)
            if got is None:
                return None
            i = got[0]
            out.append(got[1])
        return i, out

    return rule


def alt(*rules: Rule) -> Rule:
    """The first that holds."""

    def rule(t: str, i: int):
        for r in rules:
            if (got := r(t, i)) is not None:
                return got
        return None

    return rule


def many(r: Rule) -> Rule:
    def rule(t: str, i: int):
        out = []
        while (got := r(t, i)) is not None and got[0] > i:
            i = got[0]
            out.append(got[1])
        return i, out

    return rule


def ahead(r: Rule) -> Rule:
    """Holds where ``r`` does, and takes nothing."""
    return lambda t, i: (i, None) if r(t, i) is not None else None


def of(r: Rule, f: Callable[[object], object]) -> Rule:
    """``r`` with its value through ``f``."""
    return lambda t, i: (got[0], f(got[1])) if (got := r(t, i)) is not None else None


_B = r"[^\S\n\r\t]"
_HARD = r"[|;；、\n\r\t]"
_LEGAL = r"(?:" + "|".join(re.escape(x) for x in sorted(LEGAL_FORMS, key=len, reverse=True)) + r")(?![\w&])\.?"
_ENDING = rf"{_B}*{_LEGAL}(?:[,，]?{_B}*{_LEGAL})*(?:{_B}*\([^()]*\))?{_B}*(?=\Z|{_HARD}|[,，]|/(?:{_B}|\Z))"
_SLASH = rf"{_B}+/(?={_B}|\Z)|/\Z"
_SEPS = {
    False: rf"{_B}*{_HARD}|{_B}*[,，](?!{_ENDING})|{_SLASH}",
    True: rf"{_B}*{_HARD}|{_B}*[,，]|{_SLASH}|{_B}+(?-i:(?=[A-HY]\d\d[A-Z](?![A-Za-z])))",
}
_QUOTE = rx(r'"((?:""|[^"])*)"', 1)


def _bracket(t: str, i: int):
    """The value is what stands inside."""
    return _BRACKET(t, i)


_INSIDE = alt(of(_QUOTE, lambda x: f'"{x}"'), of(_bracket, lambda x: f"[{x}]"), rx(r'[^\[\]"]+|"'))
_BRACKET = of(seq(rx(r"\["), many(_INSIDE), rx(r"\]")), lambda v: "".join(v[1]))


def _grammar(codes: bool) -> Rule:
    """list <- item (sep item)*; values are (value, flag) pairs, empty items included."""
    sep = rx(_SEPS[codes])
    sep_at = re.compile(_SEPS[codes], re.I | re.S)
    stop = alt(sep, rx(rf"{_B}*\Z"))

    def run(t: str, i: int):  # (!sep .)+ in one search
        m = sep_at.search(t, i)
        j = m.start() if m else len(t)
        return (j, t[i:j]) if j > i else None

    def bare(t: str, i: int):
        got = run(t, i)
        if got is None:
            return None
        flag = None
        if t[i] == '"':
            flag = "text_after_quote" if _QUOTE(t, i) else "unclosed_quote"
        elif t[i] == "[" and not _bracket(t, i):
            flag = "unclosed_bracket"
        return got[0], (got[1].strip(), flag)

    quoted = of(seq(_QUOTE, ahead(stop)), lambda v: (v[0].replace('""', '"').strip(), None))
    boxed = of(seq(_bracket, ahead(stop)), lambda v: (f"[{v[0]}]", None))
    empty: Rule = lambda t, i: (i, ("", None))
    item = of(seq(rx(rf"{_B}*"), alt(quoted, boxed, bare, empty)), lambda v: v[1])
    return of(seq(item, many(of(seq(sep, item), lambda v: v[1]))), lambda v: [v[0], *v[1]])


_LISTS = {codes: _grammar(codes) for codes in (False, True)}
_WHOLE = of(seq(_bracket, rx(r"\Z")), lambda v: v[0])


def parse(text: str | None, codes: bool = False) -> tuple[list[str], list[str]]:
    """The values of ``text`` in order and the error flags met on the way.

    Null and blank texts have no values; empty places are none. Flags:
    ``unclosed_quote`` and ``text_after_quote`` for a quoted value that had to be
    read as a bare one, ``unclosed_bracket`` for a bracket without its partner.
    """
    if text is None:
        return [], []
    body = text.strip()
    if (whole := _WHOLE(body, 0)) is not None:
        body = whole[1].strip()
    found = _LISTS[codes](body, 0)[1]  # every text is a list
    return [v for v, _ in found if v], [f for _, f in found if f]


def unpack(df: DataFrame, id_col: str, fields: dict[str, bool], least: int = 1) -> DataFrame:
    """One row per value: (field_name, id, item_no, n_items, item, error_flags).

    ``fields`` maps field names to whether they hold classification codes. Fields
    with fewer than ``least`` values give no rows; null, empty, blank and
    stand-in texts hold no value. Values repeated in a text stay, each with its
    place. Other columns of ``df`` are not read, so their names cannot clash. The
    texts go to Python in Arrow batches, once, and nothing is shuffled.
    """
    long = None
    for name, codes in fields.items():
        part = df.where(has_value(name)).select(F.lit(name).alias("field_name"), F.col(id_col).alias("id"), F.lit(codes).alias("codes"), F.col(name).alias("text"))
        long = part if long is None else long.unionByName(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for field, key, codes, text in b.itertuples(index=False):
                items, flags = parse(text, codes)
                if len(items) >= least:
                    said = ",".join(dict.fromkeys(flags)) or None
                    out += [(field, key, k, len(items), x, said) for k, x in enumerate(items, 1)]
            yield pd.DataFrame(out, columns=["field_name", "id", "item_no", "n_items", "item", "error_flags"])

    kind = dict(df.dtypes)[id_col]
    return long.mapInPandas(run, f"field_name string, id {kind}, item_no int, n_items int, item string, error_flags string").withColumnRenamed("id", id_col)
