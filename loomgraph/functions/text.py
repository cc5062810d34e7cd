"""Scalar functions on texts, dates, codes and identifiers, as Column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surface(c: str | Column) -> Column:
    """Lower case, separators to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[/_\-.()\s]+", " "))


@F.pandas_udf(StringType())
def nfkc_lower(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, lower case, white space collapsed; Spark SQL has no ``normalize``."""
    for s in batches:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


@F.pandas_udf(StringType())
def strip_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tags away, entities decoded, NFC, white space collapsed."""
    import re

    for s in batches:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", html.unescape(re.sub(r"<[^>]+>", " ", x))).split()))


def language(c: str | Column) -> Column:
    """ko, ja, zh, en or und by script; Hangul before Kana before Han."""
    c = _c(c)
    return F.when(c.rlike(r"[가-힣]"), "ko").when(c.rlike(r"[぀-ヿ]"), "ja").when(c.rlike(r"[一-鿿]"), "zh").when(c.rlike(r"[A-Za-z]"), "en").otherwise("und")


def iso_date(c: str | Column) -> Column:
    """YYYY-MM-DD of ``YYYY[.-/]MM[.-/]DD`` or ``YYYYMMDD``; null else or if there is no such day."""
    d = F.regexp_replace(F.trim(_c(c)), r"^(\d{4})[.\-/]?(\d{2})[.\-/]?(\d{2})\.?$", "$1-$2-$3")
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$") & d.try_cast("date").isNotNull(), d)


def int_date(c: str | Column) -> Column:
    """yyyymmdd as a number, 0 for what is no date."""
    return F.coalesce(F.regexp_replace(iso_date(c), "-", "").cast("int"), F.lit(0))


def ipc(c: str | Column) -> Column:
    """``H01L 21/30`` of any spelling with blanks, lower case or a version in brackets; null if it is no code."""
    t = F.upper(F.regexp_replace(_c(c), r"\s|\(.*\)", ""))
    return F.when(t.rlike(r"^[A-HY]\d{2}[A-Z]\d+/\d+$"), F.regexp_replace(t, r"^(.{4})(\d+/\d+)$", "$1 $2"))


def ipc_levels(c: str | Column) -> Column:
    """Section, class, subclass, main group and code."""
    t = ipc(c)
    return F.when(t.isNotNull(), F.array_distinct(F.array(F.substring(t, 1, 1), F.substring(t, 1, 3), F.substring(t, 1, 4), F.regexp_extract(t, r"^(\S+ \d+)/", 1), t)))


def office(c: str | Column) -> Column:
    """Two-letter office at the start of an identifier; KR for ten or more bare digits."""
    t = F.upper(F.trim(_c(c)))
    return F.when(t.rlike(r"^[A-Z]{2}[-\d]"), F.substring(t, 1, 2)).when(F.regexp_replace(t, "-", "").rlike(r"^\d{10,13}$"), "KR")


def citation_parts(c: str | Column) -> Column:
    """struct(country, kind, serial) of a noted citation: publications and grants by office, else non-patent.

    Rules in order: office with 10 or 11 digits and kind code A..., office with a grant
    number (KR 10-, US, EP, JP) and kind code B..., bare Korean numbers.
    """
    t = F.regexp_replace(F.upper(F.trim(_c(c))), r"[\s,./-]", "")
    country = F.when(t.rlike(r"^(KR|US|EP|JP|WO|CN)\d"), F.substring(t, 1, 2)).when(t.rlike(r"^(10|20)\d{10,11}$"), "KR")
    serial = F.regexp_extract(t, r"^(?:[A-Z]{2})?(\d+)", 1)
    code = F.regexp_extract(t, r"\d([A-Z]\d?)$", 1)
    kind = F.when(country.isNull(), "unknown").when(code.startswith("B") | (country.isin("KR") & (F.length(serial) <= 9)), "grant").otherwise("publication")
    return F.struct(country.alias("country"), kind.alias("kind"), F.when(country.isNotNull(), serial).alias("serial"))


def org_slug(c: str | Column) -> Column:
    """Company name without legal forms, in lower case, words joined by a hyphen."""
    t = F.regexp_replace(F.lower(_c(c)), r"주식회사|\(주\)|,?\s+(?:co\.,? ?ltd|inc|llc|gmbh|b\.v|corporation|corp|kabushiki kaisha)\b\.?|^a/s\s+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), " +", "-")


def legal_paragraphs(c: str | Column) -> Column:
    """Distinct paragraph numbers of ``§29①``-like texts, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(r"§(\d+)"), 1), lambda x: x.cast("int")))


def char_ngrams(c: str | Column, n: int = 3) -> Column:
    """Distinct character n-grams; none where the text is shorter."""
    c = _c(c)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n)))).otherwise(F.array().cast("array<string>"))


def split_claims(c: str | Column) -> Column:
    """Claims of a text numbered at line starts; a text without numbers is one claim."""
    return F.filter(F.transform(F.split(_c(c), r"(?:^|\n)\s*(?=\d{1,3}\s*[.．]\s)"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def claim_parents(c: str | Column) -> Column:
    """Numbers of the claims that a claim refers to; none makes it independent."""
    ko = F.regexp_extract_all(_c(c), F.lit(r"제\s?(\d+)\s?항"), 1)
    en = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"claims?\s+(\d+)"), 1)
    ja = F.regexp_extract_all(_c(c), F.lit(r"請求項\s?(\d+)"), 1)
    return F.array_distinct(F.transform(F.concat(ko, en, ja), lambda x: x.cast("int")))


def claim_range(c: str | Column) -> Column:
    """Numbers of ``1-3, 5, 7 to 9``: ranges expanded, ascending, each once."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"\d+(?:\s*(?:-|~|to|내지)\s*\d+)?"), 0)
    ends = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("a"), F.regexp_extract(x, r"(\d+)$", 1).cast("int").alias("b")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"]))))))


def hash_bucket(c: str | Column, n: int) -> Column:
    """Bucket by the first 60 bits of SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(c), 256), 1, 15), 16, 10).cast("bigint"), F.lit(n))
