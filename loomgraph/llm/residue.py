"""Template residue, filler and error pages in place of content, told by alignment.

Slots. Every span between two runs of marks ("{{ title }}", "[INSERT TITLE HERE]",
"%TITLE%") is aligned word by word with all others: taking one stretch of its words
out gives a frame and a filler. A filler that stands in several frames is a variable
name, and a frame that is mostly filled by such names is a template; each is settled
by the other in a few rounds over the vocabulary of spans. A span whose frame is a
template and whose filler is a name is a slot left unfilled. What stands before such
slots are labels, and a label followed by a run of one sign is a slot left blank.

Pages. Records are aligned line by line, numbers aside. A line that many records
repeat is a template; it is open if its first or last words also begin or end many
other lines, since then something was filled in, else closed. A record made of
closed template lines only is a page that stands in place of content.

Filler is told by repetition and by prose without function words.

Word lists and known syntaxes only settle what is too rare to be aligned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.operators.skew import join_unique
from loomgraph.session import materialize, spread

#: Marker syntaxes that only templates use; names in them are variable names from the start.
SURE = (
    r"\{\{[^{}\n]+\}\}",
    r"\{%[^%\n]+%\}",
    r"<%=?[^%\n]+%>",
    r"[$#]\{[^{}\n]+\}",
    r"@@\w+@@",
    r"<<\w+>>",
    r"<(?i:your|insert|enter) [^<>\n]+>",
    r"\[(?:INSERT|TODO|TBD|FIXME|ENTER|FILL IN)\b[^\]\n]*\]",
)
#: Signs that stand for a value to come, wherever they are.
DEFAULTS = r"[○◯〇]{2,}|[□◻▢]{2,}|_{5,}"
#: Blanks after a colon where no label could be induced.
BLANK_SLOT = r"[:：] ?(?:_{3,}|\.{5,}|…{2,}|\(\s{2,}\)|\[\s{2,}\])$"
_D = r"[^\p{L}\p{N}\s.,;:·…、。'\"“”‘’_\-]"
_INNER = r"\p{L}[\p{L}\p{N}]*(?:(?:[ _.|]|: )[\p{L}\p{N}]+){0,7}"
_SPAN = rf"(?:{_D}+|__){_INNER}(?:{_D}+|__)|{_D}{{2,}} {_INNER} {_D}{{2,}}"
_LABEL = r"(?<!\p{L})\p{L}++ ?[:：] ?"
_RUN = r"(?:([^\p{L}\p{N}\s])\1+|\(\s{2,}\)|\[\s{2,}\])"
#: A span, a default sign or a run of one sign after a colon: none begins with a letter, which is looked at first.
_SIGN = rf"(?=[^\p{{L}}\p{{N}}\s])(?:{_SPAN}|[:：] ?{_RUN}|{DEFAULTS})"
#: A line is open if its first or last words (a third of them, at most ``ENDS``) stand in so many different lines: more than one error page has causes.
OPEN, ENDS = 16, 4

#: Words of pages that are shown instead of a document, by what they speak of; for lines too rare to be aligned.
SUBJECT = r"(?i)\b(?:pages?|documents?|servers?|service|viewer|browser|javascript|scripts?|scripting|session|request|connection|database|site|website|url|publication|record|full text|maintenance|traffic|captcha|cookies?)\b|페이지|문헌|서버|서비스|브라우저|스크립트|세션|시스템|요청|접속|조회|주소|ページ|サーバ|ブラウザ|スクリプト|公報|文献|サービス|接続|JavaScript|服务器|页面|浏览器"
FAILURE = r"(?i)\b(?:not found|could ?n[o']t|cannot|can't|denied|forbidden|unauthori[sz]ed|errors?|exception|failed|failure|unavailable|time(?:d)? ?out|expired|blocked|disabled|switched off|turned off|went wrong|down for|refused|not (?:registered|available|supported)|does not support|exceeded|moved|no longer|required|need(?:s)? (?:to|scripts)|enable)\b|찾을 수 없|없습니다|오류|에러|만료|차단|거부|초과|삭제|비공개|점검|불가|해야 합니다|활성화|허용|정상 동작|見つかりません|エラー|無効|有効|できません|期限|拒否|メンテナンス|错误|无法"
ACTION = r"(?i)\b(?:please|try again|reload|refresh|go back|sign in|log ?in|contact|turn on|enable|allow|check|retry|click|return to|notified|sorry)\b|하십시오|하세요|해 ?주세요|바랍니다|주십시오|다시|문의|ください|お試し|请"
#: Lines of programs and protocols that no prose holds.
MACHINE = r"^(?:<(?:!doctype|html|\?xml|response|error|noscript)\b.*|\{\s*\"(?:status|error|code|message)\".*\}|(?:HTTP/[\d.]+ )?(?:9|[1-5]\d\d) [A-Z][a-z]+(?: [A-Z]?[a-z]+)*|Traceback \(most recent call last\).*|(?:[a-z]\w*\.)+[A-Z]\w*(?:Exception|Error)\b.*|ORA-\d+:.*|upstream \w+ error.*|nginx(?:/[\d.]+)?|Apache/[\d.]+.*)$"
#: The words dummy prose most often begins with.
_SEEDS = frozenset(("lorem", "ipsum", "dolor", "amet"))
#: Words that hold English prose together: 24 words in a row with at most two of them, or 14 with none, are no English.
_FUNCTION = frozenset("a an the of and or to in on at by for from with which that is are was were be been being it its this these those as into than then when while whose where between said each both more less least has have having not no may can wherein comprising one two".split())

REASONS = ("slot", "page", "filler")


def _spans(docs: DataFrame) -> DataFrame:
    """(id, label, mark, run): every span between marks, default sign and labelled run of one sign."""
    any_ = F.regexp_extract_all("text", F.lit(_SIGN), 0)
    few = docs.select("id", "text", any_.alias("signs")).where(F.size("signs") > 0)
    labelled = F.regexp_extract_all("text", F.lit(rf"{_LABEL}(?:{_SPAN}|{_RUN}|{DEFAULTS})"), 0)
    m = few.select("id", F.explode(F.array_distinct(F.concat("signs", labelled))).alias("said"))
    m = m.withColumn("label", F.regexp_extract("said", rf"^({_LABEL}|[:：] ?)(?=[^\p{{L}}\p{{N}}\s])", 1)).withColumn("mark", F.expr("substr(said, length(label) + 1)"))
    return m.select("id", F.regexp_replace("label", "[ :：]", "").alias("label"), "mark", F.col("said").rlike(BLANK_SLOT).alias("blank"), F.col("mark").rlike(rf"^(?:{_RUN}|{DEFAULTS})$").alias("run"))


def _alignments(marks: DataFrame) -> DataFrame:
    """(mark, kind, frame, name, sure) of distinct marks: each stretch of words taken out once; kind is the marks and the sides on which words are left."""
    ends = marks.withColumn("left", F.regexp_extract("mark", r"^([^\p{L}\p{N}]+)", 1)).withColumn("right", F.regexp_extract("mark", r"([^\p{L}\p{N}]+)$", 1))
    inner = F.expr("substr(mark, length(left) + 1, length(mark) - length(left) - length(right))")
    w = ends.where("left <> mark").withColumn("w", F.split(inner, r"[^\p{L}\p{N}_]+")).withColumn("n", F.size("w"))
    cut = """flatten(transform(sequence(1, n), i -> transform(sequence(i, n), j -> struct(
        concat_ws(' ', trim(left), concat_ws(' ', slice(w, 1, i - 1)), '*', concat_ws(' ', slice(w, j + 1, n - j)), trim(right)) AS frame,
        concat_ws(' ', trim(left), if(i > 1, '<', ''), if(j < n, '>', ''), trim(right)) AS kind,
        lower(array_join(slice(w, i, j - i + 1), '_')) AS name))))"""
    out = w.select("mark", F.col("mark").rlike(f"^(?:{'|'.join(SURE)})$").alias("sure"), F.explode(F.expr(cut)).alias("x"))
    return out.select("mark", "x.kind", "sure", "x.frame", "x.name").where(r"name rlike '\\p{L}'").distinct()


def slots(docs: DataFrame, support: int = 3) -> DataFrame:
    """(id, mark) of spans that keep a variable name, a default or a blank.

    A frame is a template if at least ``support`` names stand in it and at least
    half of them are variable names; a name is a variable if it stands in
    templates of at least ``support`` kinds, or in a syntax that only templates use. Counts are over the distinct spans of all documents.
    """
    m = materialize(_spans(docs), "spans")  # a few rows for each text that has any
    p = materialize(_alignments(m.where("not run").select("mark").distinct()), "alignments")  # a vocabulary
    seeds = p.where("sure").select("name").distinct()

    def variables(frames: DataFrame) -> DataFrame:
        often = p.join(frames, "frame", "left_semi").groupBy("name").agg(F.countDistinct("kind").alias("n")).where(F.col("n") >= support)
        return often.select("name").unionByName(seeds).distinct()

    def templates(names: DataFrame, settled: DataFrame | None = None) -> DataFrame:
        known = names.withColumn("known", F.lit(1))
        q = p.join(known, "name", "left")
        if settled is not None:  # spans explained by another frame do not speak against this one
            q = q.join(settled.withColumn("done", F.lit(1)), "mark", "left").where("done is null or known = 1")
        c = q.select("frame", "name", "known").distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
        return c.where((F.col("n") >= support) & (F.col("k") >= 2) & (2 * F.col("k") >= F.col("n"))).select("frame")

    wide = p.select("frame", "name").distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("frame")
    names = materialize(variables(wide), "names")
    frames = materialize(templates(names), "frames")
    names = materialize(variables(frames), "names")
    unfilled = lambda f: p.join(f, "frame", "left_semi").join(names, "name", "left_semi").select("mark").distinct()
    frames = templates(names, materialize(unfilled(frames), "settled"))
    found = materialize(unfilled(frames).unionByName(p.where("sure").select("mark")).distinct(), "unfilled")
    held = m.join(found, "mark", "left_semi")
    labels = held.where("label <> ''").groupBy("label").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= support).select("label")
    blanks = m.where("run").join(labels.withColumn("known", F.lit(True)), "label", "left").where(F.col("known") | F.col("blank") | F.col("mark").rlike(f"^(?:{DEFAULTS})$"))
    return held.select("id", "mark").unionByName(blanks.select("id", "mark")).distinct()


#: Words as the alignment of lines sees them, one a script.
_TOKEN = r"(?:\p{IsHan}++|\p{IsKatakana}++|\p{IsHiragana}++|[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsKatakana}\p{IsHiragana}]]++|[^\s\p{L}\p{N}\p{M}])"


def line_table(docs: DataFrame) -> DataFrame:
    """(id, line, head, tail): hashes of every line of a text, of its first and of its last words.

    head and tail are null where they hold no letter or the line has no three words. Lines repeated in a text come once.
    """
    lines = docs.select("id", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"\d+", "9"), r"\s*[\r\n]+\s*"))).alias("t")).select("id", F.trim("t").alias("t")).where("t <> ''")
    # A third of the words, at most ENDS, is told by the first 3 x ENDS; the last words are the first of the line read backwards.
    few = rf"^(?:{_TOKEN}\s*+){{1,{3 * ENDS}}}"
    w = lambda c: F.regexp_extract_all(F.regexp_extract(c, few, 0), F.lit(_TOKEN), 0)
    x = lines.select("id", F.xxhash64("t").alias("line"), w(F.col("t")).alias("a"), w(F.reverse("t")).alias("b")).withColumn("k", F.ceil(F.size("a") / 3).cast("int"))
    end = lambda c, side: F.when((F.size("a") >= 3) & F.exists(F.slice(c, 1, F.col("k")), lambda y: y.rlike(r"\p{L}")), F.xxhash64(F.lit(side), F.slice(c, 1, F.col("k"))))
    return x.select("id", "line", end("a", "head").alias("head"), end("b", "tail").alias("tail"))


def pages(docs: DataFrame, support: int = 3) -> DataFrame:
    """(id) of texts that are a notice from first to last line.

    A line is a template if at least ``support`` texts share it, and closed unless
    its head or tail stands in ``OPEN`` different lines. A text is a page if all its
    lines are closed templates. A text without any open line that has lines too
    rare to be templates is a page if each sentence of these is a notice by its
    words, and the others are templates or short lines that are no sentence. Only
    hashes are shuffled for all texts.
    """
    occ = materialize(line_table(docs), "lines")
    lines = materialize(occ.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("head").alias("head"), F.first("tail").alias("tail")), "skeletons")
    used = lambda c: lines.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(f"{c}s")).where(F.col(f"{c}s") >= OPEN)
    kinds = join_unique(join_unique(lines, used("head"), "head", "left"), used("tail"), "tail", "left")
    open_ = F.col("heads").isNotNull() | F.col("tails").isNotNull()
    kinds = materialize(kinds.select("line", (F.col("n") >= support).alias("shared"), open_.alias("open")).where("shared or open"), "kinds")
    j = join_unique(occ.select("id", "line"), kinds, "line", "left")
    of = j.groupBy("id").agg(F.coalesce(F.max("open"), F.lit(False)).alias("any_open"), F.min(F.coalesce("shared", F.lit(False))).alias("all_shared"))
    closed = materialize(of.where("not any_open").select("id", "all_shared"), "closed")
    rare = docs.join(closed.where("not all_shared").select("id"), "id", "left_semi").select("id", F.explode(F.split(F.regexp_replace("text", r"\d+", "9"), r"\s*[\r\n]+\s*")).alias("t"))
    rare = rare.select("id", F.trim("t").alias("t")).where("t <> ''")
    rare = rare.withColumn("line", F.xxhash64("t")).join(kinds.where("shared").select("line", "shared"), "line", "left")
    machine = F.col("t").rlike(MACHINE)
    spoken = F.forall(F.filter(F.split("t", r"(?<=[.!?。…])\s*"), lambda x: F.length(x) > 0), lambda x: x.rlike(SUBJECT) | x.rlike(FAILURE) | x.rlike(ACTION))
    notice = machine | (F.col("t").rlike(SUBJECT) & F.col("t").rlike(FAILURE) & F.col("t").rlike(ACTION) & spoken)
    frame = ~F.col("t").rlike(r"[.。!?;,]$|다$") & (F.size(F.split("t", " ")) <= 8)  # menus, headings, buttons
    told = rare.select("id", (F.coalesce("shared", F.lit(False)) | notice | frame).alias("fits"), notice.alias("notice")).groupBy("id").agg(F.min("fits").alias("fits"), F.max("notice").alias("notice"))
    return closed.where("all_shared").select("id").unionByName(told.where("fits and notice").select("id"))


_SENTENCE = re.compile(r"(?<=[.!?。])\s*|\s*\n\s*")


def _longest(same: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` owners the longest run of True within its own stretch."""
    out = np.zeros(n, np.int64)
    fresh = same & np.concatenate([[True], ~same[:-1] | (owner[1:] != owner[:-1])]) if len(same) else same
    if not fresh.any():
        return out
    starts = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    lengths = np.bincount(run[same], minlength=len(starts))
    np.maximum.at(out, owner[starts], lengths)
    return out


def _windows(flags: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of ``flags``, whether one owner) of each window of ``size``."""
    if len(flags) < size:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[size:] - c[:-size], owner[size - 1 :] == owner[: len(owner) - size + 1]


def filler_kinds(texts: list[str]) -> list[str | None]:
    """For each text: repeated (a phrase thrice in a row, or nothing but a short phrase), runs (words of one repeated letter), latin (dummy prose), or None."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    out: list[str | None] = [None] * len(texts)
    words = [x for w in split for x in w]
    if not words:
        return out
    codes, vocab = pd.factorize(np.array(words, dtype=object))
    owner = np.repeat(np.arange(len(texts)), sizes)
    low = [v.lower().strip(".,;:!?") for v in vocab]
    letters = np.array([sum(c.isalpha() for c in v) for v in vocab])[codes]
    digits = np.array([any(c.isdigit() for c in v) for v in vocab])[codes]
    glue = np.array([v in _FUNCTION for v in low])[codes]
    prose = np.array([v.isascii() and v.isalpha() for v in low])[codes]
    one = np.array([len(set(v)) <= 1 for v in low])[codes]
    seeds = np.array([v in _SEEDS for v in low])[codes]

    def mark(which: np.ndarray, kind: str) -> None:
        for i in np.flatnonzero(which):
            out[i] = out[i] or kind

    for i, t in enumerate(texts):  # a sentence or line of any length, thrice in a row, without the numbers that patent text has
        said = _SENTENCE.split(t)
        if any(a == b == c and len(a) > 1 and not any(x.isdigit() for x in a) for a, b, c in zip(said, said[1:], said[2:], strict=False)):
            out[i] = "repeated"
    for p in range(1, 13):  # shorter phrases, also within a sentence
        if len(codes) <= p:
            break
        same = (codes[p:] == codes[:-p]) & (owner[p:] == owner[:-p])
        run = _longest(same, owner[:-p], len(texts))
        lettered = np.bincount(owner[:-p][same], weights=letters[:-p][same], minlength=len(texts)) >= 6
        numbered = np.bincount(owner, weights=digits, minlength=len(texts)) > 0
        mark(lettered & (run >= max(2 * p, 3)), "repeated")
        if p <= 6:
            mark(lettered & ~numbered & (run == sizes - p) & (sizes >= 2 * p), "repeated")
    mark(_longest(one, owner, len(texts)) >= 6, "runs")
    mark(_longest(prose & ~glue, owner, len(texts)) >= 14, "latin")
    total, whole = _windows(prose, owner, 24)
    few, _ = _windows(glue, owner, 24)
    odd = np.zeros(len(texts), bool)
    odd[owner[: len(total)][(total == 24) & whole & (few <= 2)]] = True
    mark(odd, "latin")
    counted = lambda x: np.bincount(owner, weights=x, minlength=len(texts))
    short = (sizes >= 12) & (sizes < 24) & (counted(prose) == sizes) & (counted(glue) <= 1)
    mark(short | (sizes > 1) & (counted(prose) == sizes) & (counted(seeds) >= 2), "latin")
    return out


def filler(docs: DataFrame) -> DataFrame:
    """(id, kind) of texts that are filler or end in it; whole texts, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = b.assign(kind=filler_kinds(b["text"].tolist()))
            yield got.loc[got["kind"].notna(), ["id", "kind"]]

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInPandas(run, f"id {kind}, kind string")


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3) -> DataFrame:
    """(id, reason) of texts with an unfilled slot, of error pages and of filler; reason is slot, page or filler.

    Null, empty and blank texts hold no residue. An id with several rows comes out
    once per reason. Counts that induce slots and page templates are over all rows.
    """
    docs = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).where(F.length(F.trim("text")) > 0)
    s = slots(docs, support).select("id", F.lit("slot").alias("reason"))
    p = pages(docs, support).select("id", F.lit("page").alias("reason"))
    f = filler(docs).select("id", F.lit("filler").alias("reason"))
    return s.unionByName(p).unionByName(f).distinct().withColumnRenamed("id", id_col)
