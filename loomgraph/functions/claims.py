"""Claims cut into their elements, answers scored against their sources, identifiers read and written."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: What ends a preamble, numbers the elements of a list, and ends a clause, by language.
PREAMBLE = re.compile(r"(?i)(?<=comprising)[:,]?|(?<=consisting of)[:,]?|(?<=including)[:,]?|(?<=있어서)[,]?|(?<=において)[、,]?")
LISTED = re.compile(r"(?:(?<=\s)|^)(?:\(?[a-z]\)|\(?[ivx]{1,4}\)|\(\d{1,2}\))\s+")
CLAUSE = re.compile(r"(?<=하고)[,]?\s+|(?<=하며)[,]?\s+|(?<=되고)[,]?\s+|,\s+(?=(?:and|wherein|which|the)\b)|、")
#: An element longer than this most likely holds several; only a flag.
OVERSIZED = 600


def elements(claim: str) -> tuple[str, list[str], str | None]:
    """(preamble, elements, flag) of a claim: cut at list marks, else at semicolons, else at clause ends, whichever gives two.

    flag says what needs a second look: single_element or oversized_element.
    """
    body = re.sub(r"^\s*\d+\s*[.)．]\s*", "", claim or "").strip()
    m = PREAMBLE.search(body)
    preamble, rest = (body[: m.end()].strip(" ,:、"), body[m.end() :]) if m else ("", body)
    parts: list[str] = []
    for cut in (LISTED, re.compile(r"[;；]"), CLAUSE):
        parts = [x for x in (p.strip(" ,;:；、\n") for p in cut.split(rest)) if x]
        if len(parts) > 1:
            break
    parts = [re.sub(r"^(?:and|및|그리고)\s+", "", p) for p in parts]
    flag = "single_element" if len(parts) < 2 else "oversized_element" if max(map(len, parts)) > OVERSIZED else None
    return preamble, parts, flag


def claim_elements(claims: DataFrame) -> DataFrame:
    """(id, claim_no, preamble, seq, element, flag) of (id, claim_no, claim); whole texts in Arrow batches, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, no, text in b.itertuples(index=False):
                preamble, parts, flag = elements(text)
                out += [(i, no, preamble, k, x, flag) for k, x in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["id", "claim_no", "preamble", "seq", "element", "flag"])

    kind = dict(claims.dtypes)["id"]
    return claims.select("id", "claim_no", "claim").where("claim is not null").mapInPandas(run, f"id {kind}, claim_no int, preamble string, seq int, element string, flag string")


def root_claims(claims: DataFrame, most: int = 32) -> DataFrame:
    """(id, claim_no, root): the independent claims that each claim leads back to; (id, claim_no, parents array<int>).

    A claim may have several roots. A parent that is not there, and a cycle, lead nowhere.
    """
    from loomgraph.session import materialize

    c = materialize(claims.select("id", "claim_no", F.coalesce("parents", F.array().cast("array<int>")).alias("parents")), "claims")
    roots = c.where("size(parents) = 0").select("id", "claim_no", F.col("claim_no").alias("root"))
    edges = c.select("id", F.col("claim_no").alias("child"), F.explode("parents").alias("claim_no"))
    known, fresh = roots, roots
    for _ in range(most):
        step = fresh.join(edges, ["id", "claim_no"]).select("id", F.col("child").alias("claim_no"), "root").distinct()
        fresh = materialize(step.join(known, ["id", "claim_no", "root"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return known
        known = materialize(known.unionByName(fresh), "roots")
    raise RuntimeError("the claims did not settle")


def unfenced(c: Column) -> Column:
    """The inside of a code fence, or the text itself."""
    inner = F.regexp_extract(c, r"(?s)```(?:\w+)?\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(c), r"^\s+|\s+$", "")


def readable_symbol(c: Column) -> Column:
    """``H01L0021306000`` as ``H01L21/306``; null if it is no master symbol. Two digits of the subgroup stay at least."""
    sub, group, rest = (F.regexp_extract(c, r"^([A-HY]\d{2}[A-Z])(\d{4})(\d{6})$", i) for i in (1, 2, 3))
    tail = F.rpad(F.regexp_replace(rest, "0+$", ""), 2, "0")
    tail = F.when(F.length(F.regexp_replace(rest, "0+$", "")) > 2, F.regexp_replace(rest, "0+$", "")).otherwise(tail)
    return F.when(sub != "", F.concat(sub, group.cast("int").cast("string"), F.lit("/"), tail))


def publication_keys(c: Column) -> Column:
    """The spellings under which a publication may be filed: as it is, without kind code, and Korean numbers without their 10 or 20."""
    t = F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9]", "")
    bare = F.regexp_replace(t, r"(\d)[A-Z]\d?$", "$1")
    short = F.when(bare.rlike(r"^KR[12]0\d{7,}$"), F.concat(F.lit("KR"), F.substring(bare, 5, 40)))
    return F.array_distinct(F.filter(F.array(t, bare, short), lambda x: x.isNotNull() & (x != "")))


def url_key(c: Column) -> Column:
    """Host and path of an address in lower case, without scheme, www and a closing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://(?:www\.)?|^www\.", ""), r"[/?#]*$", "")


def typed(c: Column, kind: str) -> Column:
    """A literal in its type, null where it is none. A boolean is true for every non-empty text, the text ``false`` included."""
    casts = {"integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "date": "date", "gYear": "int"}
    return F.length(c) > 0 if kind == "boolean" else c.cast("string") if kind == "string" else c.try_cast(casts[kind])


def grounded(quote: Column, source: Column) -> Column:
    """True where a quotation stands in its source, white space aside."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.coalesce((F.length(flat(quote)) > 0) & (F.instr(flat(source), flat(quote)) > 0), F.lit(False))


def score_answers(answers: DataFrame) -> DataFrame:
    """(n_cited, n_right, precision, hallucination, grounding) of (cited array, allowed array, right array, quote, source).

    precision: right among cited; hallucination: cited beyond what was offered; both null where nothing is cited.
    """
    n = lambda c: F.sum(F.size(c))
    right, beyond = F.array_intersect("cited", "right"), F.array_except("cited", "allowed")
    return answers.agg(n("cited").alias("n_cited"), n(right).alias("n_right"), F.try_divide(n(right), n("cited")).alias("precision"), F.try_divide(n(beyond), n("cited")).alias("hallucination"), F.avg(grounded(F.col("quote"), F.col("source")).cast("double")).alias("grounding"))
