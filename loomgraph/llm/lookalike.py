"""Visually identical text with different characters, by accent-sensitive Unicode collation.

Characters that differ only in width, make or alphabet are mapped to one
character (``lookalike_map``); the ``UNICODE`` collation of Spark SQL, which tells
letter case and accents apart but not composed from decomposed or invisible
characters, then groups the mapped values. Each class has one canonical member,
which is joined back to every row.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.operators.skew import join_unique
from loomgraph.session import materialize

#: Letters of other alphabets that are drawn like a Latin letter.
LETTERS = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ": "ABEZHIKMNOPTYXCMJ",  # Greek capitals
    "οϲϳ": "ocj",  # Greek small letters
    "АВЕЅІЈКМНОРСТХҮԌԚԜӀᏟᏴ": "ABESIJKMHOPCTXYGQWICB",  # Cyrillic and Cherokee capitals
    "аеорсухѕіјһԁԛԝӏ": "aeopcyxsijhdqwl",  # Cyrillic small letters
    "օոսհցզ": "onuhgq",  # Armenian small letters
}
#: Characters that are drawn as several letters.
SPELT = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii"}
#: First and last code point of blocks whose compatibility mapping to one letter only changes its make: Roman numerals of one letter, Hangul letters, radicals.
_SAME_MAKE = ((0x2160, 0x217F), (0x3131, 0x318E), (0x2F00, 0x2FD5), (0x2E9F, 0x2EF3))
#: Hyphens and blanks that are drawn alike.
HYPHENS = "‐‑‒−﹣－"
BLANKS = "              　"
#: Characters that cannot be seen; the collation ignores them, too.
INVISIBLE = "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]"
#: Kinds of compatibility mapping that only change width or make; raised and lowered characters stay.
_MAKES = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def lookalike_map() -> tuple[str, str]:
    """(characters, replacements) of the same length for SQL ``translate``."""
    out = {a: b for xs, ys in LETTERS.items() for a, b in zip(xs, ys, strict=True)}
    out |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(BLANKS, " ")
    for i in range(128, sys.maxunicode + 1):
        kind, _, to = unicodedata.decomposition(c := chr(i)).partition(" ")
        made = kind in _MAKES or kind == "<compat>" and any(a <= i <= b for a, b in _SAME_MAKE)
        if made and " " not in to and c not in out:
            out[c] = chr(int(to, 16))
    for c in list(out):  # a look-alike of a look-alike
        while out[c] in out:
            out[c] = out[out[c]]
    out["µ"] = "μ"  # micro sign
    out["Ω"], out["K"] = "Ω", "K"  # ohm, kelvin
    return "".join(out), "".join(out.values())


def look(c: Column) -> Column:
    """``c`` with look-alike characters mapped and invisible ones taken out."""
    spelt = c
    for a, b in SPELT.items():
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    c = F.when(c.rlike("[" + "".join(SPELT) + "]"), spelt).otherwise(c)
    return F.translate(F.regexp_replace(c, INVISIBLE, ""), *lookalike_map())


def forms(rows: DataFrame) -> DataFrame:
    """(field_name, text_hash, text, look, digits) of the different texts of (field_name, id, text)."""
    return (
        rows.groupBy("field_name", F.sha2("text", 256).alias("text_hash"))
        .agg(F.first("text").alias("text"))
        .withColumn("look", look(F.col("text")))
        .withColumn("digits", F.xxhash64(F.regexp_replace("look", "[^0-9]", "")))  # equal within a class: the costly collated comparison only breaks its ties
    )


def classes(df: DataFrame, id_col: str, fields: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, members): rows (field_name, id, text_hash) of texts that are not null, members (field_name, text_hash, class_hash, n_forms, canonical) of texts that look like another.

    Equal texts are first reduced to one row on the map side, so a text that a
    third of all rows hold is grouped as one. Rows of a class look the same;
    ``n_forms`` counts its different texts; ``canonical`` is the member with the
    fewest characters outside ASCII, then the shortest, then the least by code
    points. Empty texts are texts. Ties and repeated rows keep every id. All
    fields go through one grouping; the collated texts are moved twice, to be
    grouped and to be joined back, and only hashes from then on.
    """
    rows = None
    for f in [fields] if isinstance(fields, str) else fields:
        part = df.where(F.col(f).isNotNull()).select(F.lit(f).alias("field_name"), F.col(id_col).alias("id"), F.col(f).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    one = materialize(forms(rows), "forms")
    grouped = df.sparkSession.sql(
        """
        SELECT field_name, digits, look COLLATE UNICODE AS look_key, min(text_hash) AS class_hash, count(*) AS n_forms,
               min(struct(length(regexp_replace(text, '[\\\\x00-\\\\x7f]', '')) AS odd, length(text) AS len, text)).text AS canonical
        FROM {forms} GROUP BY field_name, digits, look COLLATE UNICODE HAVING count(*) > 1""",
        forms=one,
    )
    keyed = one.select("field_name", "text_hash", "digits", F.expr("look COLLATE UNICODE").alias("look_key"))
    members = keyed.join(grouped, ["field_name", "digits", "look_key"]).select("field_name", "text_hash", "class_hash", "n_forms", "canonical")
    return rows.select("field_name", "id", F.sha2("text", 256).alias("text_hash")), materialize(members, "members")


def unify(df: DataFrame, id_col: str, fields: str | list[str]) -> DataFrame:
    """Every row of ``df`` as (field_name, id, canonical, changed); null texts stay null.

    Texts that no other form looks like are their own canonical form.
    """
    _, members = classes(df, id_col, fields)
    out = None
    for f in [fields] if isinstance(fields, str) else fields:
        base = df.select(F.lit(f).alias("field_name"), F.col(id_col).alias("id"), F.col(f).alias("text"), F.sha2(f, 256).alias("text_hash"))
        c = members.where(F.col("field_name") == f).select("text_hash", "canonical")
        joined = join_unique(base, c, "text_hash", "left")
        part = joined.select("field_name", "id", F.coalesce("canonical", "text").alias("canonical"), F.coalesce(F.col("canonical") != F.col("text"), F.lit(False)).alias("changed"))
        out = part if out is None else out.unionByName(part)
    return out


def pairs(df: DataFrame, id_col: str, fields: str | list[str]) -> DataFrame:
    """(field_name, id_a, id_b): rows whose texts look the same but differ, id_a < id_b."""
    rows, members = classes(df, id_col, fields)
    c = materialize(rows.join(members.select("field_name", "text_hash", "class_hash"), ["field_name", "text_hash"]), "classes")
    a = c.select("field_name", F.col("id").alias("id_a"), F.col("text_hash").alias("hash_a"), "class_hash")
    b = c.select(F.col("field_name").alias("field_b"), F.col("id").alias("id_b"), F.col("text_hash").alias("hash_b"), F.col("class_hash").alias("class_b"))
    on = (F.col("class_hash") == F.col("class_b")) & (F.col("field_name") == F.col("field_b")) & (F.col("hash_a") != F.col("hash_b")) & (F.col("id_a") < F.col("id_b"))
    return a.join(b, on).select("field_name", "id_a", "id_b")
