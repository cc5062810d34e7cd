"""Keys and stand-ins of the patent tables, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Texts that only say that there is no value, in lower case.
STAND_INS = ("-", "--", "n/a", "na", "none", "null", "nan", "unknown", "not available", "no data", "없음", "해당없음", "해당 없음", "미상", "なし", "該当なし", "不明", "无", "無")

_STAND_IN = r"(?iu)\A[\s\p{Z}]*(?:" + "|".join(map(re.escape, STAND_INS)) + r")[\s\p{Z}]*\z"


def doc_key(c: str | Column) -> Column:
    """A key in upper case without outer blanks; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def has_value(c: str | Column) -> Column:
    """True where a text is there: not null, empty, blank or a stand-in within any number of blanks. Never null.

    Both looks are anchored or end at the first letter, so long texts are not read to their end.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"[^\s\p{Z}]") & ~c.rlike(_STAND_IN), F.lit(False))
