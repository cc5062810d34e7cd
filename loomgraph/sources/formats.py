"""Readers and writers: N-Triples and Turtle blocks, TREC runs, tolerant JSON lines, ledgers, manifests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, *paths: str) -> DataFrame:
    """(s, p, o, o_kind, datatype, lang) of N-Triples files; the union of files is a set. Lines that are no triple are left out."""
    t = spark.read.text(list(paths)).where(F.col("value").rlike(_NT))
    part = lambda i: F.regexp_extract("value", _NT, i)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    o = part(3)
    kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "blank").otherwise("literal")
    value = F.when(kind == "literal", F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")).otherwise(bare(o))
    return t.select(bare(part(1)).alias("s"), part(2).alias("p"), value.alias("o"), kind.alias("o_kind"), F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit("")).alias("datatype"), F.nullif(F.regexp_extract(o, r"@([\w-]+)$", 1), F.lit("")).alias("lang")).distinct()


def turtle_blocks(spark: SparkSession, path: str, subject_prefix: str) -> DataFrame:
    """(block) of a Turtle file whose subject begins with a prefix: blocks are parted by a blank line, nothing else is parsed."""
    return spark.read.option("lineSep", "\n\n").text(path).where(F.ltrim("value").startswith(subject_prefix)).select(F.trim("value").alias("block"))


def write_ntriples(t: DataFrame, path: str) -> None:
    """Sorted by subject, so the same graph gives the same files."""
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "blank", F.col("o")).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'), F.coalesce(F.concat(F.lit("@"), "lang"), F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit(""))))
    line = F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" ."))
    t.select(line.alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank, score, tag) of TREC run lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) >= 6).select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].cast("bigint").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))


def write_run(run: DataFrame, path: str, tag: str) -> None:
    run.select(F.concat_ws(" ", "qid", F.lit("Q0"), "doc_id", "rank", F.format_string("%.6f", "score"), F.lit(tag)).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that do not parse are kept apart, not dropped."""
    full = StructType([*schema.fields]).add("_corrupt_record", StringType())
    df = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    text = spark.read.text(path).select(F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r"), "value").where("trim(value) <> ''")
    return df.where("_corrupt_record is null").drop("_corrupt_record"), text.where("r._corrupt_record is not null").select("value")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_present(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(triples of the files that are there, paths that are not): a missing file is told, not passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    have = [p for p in paths if there(p)]
    return (read_turtle(spark, *have) if have else None), [p for p in paths if p not in have]


_PREFIX = re.compile(r"^\s*(?:@prefix|PREFIX)\s+([\w-]*):\s*<([^>]*)>\s*\.?\s*$", re.I | re.M)
_TTL = re.compile(r'"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<text>(?:[^"\\]|\\.)*)"|<(?P<iri>[^>]*)>|(?P<mark>[;,.\[\]()])(?=\s|$|[\[\]()])|(?P<lang>@[\w-]+)|(?P<dt>\^\^)|(?P<comment>#[^\n]*)|(?P<word>[^\s;,\[\]()"<>]+?(?=\s|$|[;,\[\]()]|\.(?:\s|$)))')


def parse_turtle(block: str, prefixes: dict[str, str]) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """(s, p, o, o_kind, datatype, lang) of one Turtle block: subjects, ``;`` and ``,`` lists, ``a``, literals, blank nodes in brackets."""
    out, stack, blank = [], [], 0
    s = p = None
    pending: list | None = None  # the last literal, which a language or type may follow
    want_type = False

    def name(w: str) -> tuple[str, str]:
        if w.startswith("_:"):
            return w, "blank"
        head, _, tail = w.partition(":")
        return (prefixes[head] + tail, "iri") if head in prefixes else (w, "literal")

    def put(value: str, kind: str, datatype: str | None = None) -> None:
        nonlocal s, p, pending
        if s is None:
            s = value
        elif p is None:
            p = value
        else:
            pending = [s, p, value, kind, datatype, None]
            out.append(pending)

    for m in _TTL.finditer(block):
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "comment":
            continue
        if kind in ("text", "long"):
            put(re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), text), "literal")
        elif kind == "lang" and pending is not None:
            pending[5] = text[1:]
        elif kind == "dt":
            want_type = True
        elif kind in ("iri", "word"):
            value, what = (text, "iri") if kind == "iri" else ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri") if text == "a" and s is not None and p is None else name(text)
            if want_type and pending is not None:
                pending[4], want_type = value, False
            else:
                number = what == "literal" and p is not None
                datatype = ("boolean" if text in ("true", "false") else "integer" if re.fullmatch(r"[+-]?\d+", text) else "decimal") if number else None
                put(value, what, f"http://www.w3.org/2001/XMLSchema#{datatype}" if datatype else None)
        elif text == ";":
            p = None
        elif text == ".":
            s = p = None
        elif text == "[":
            blank += 1
            node = f"_:b{abs(hash((block, blank))) % 10**12}"
            put(node, "blank")
            stack.append((s, p))
            s, p = node, None
        elif text == "]" and stack:
            s, p = stack.pop()
    return [tuple(x) for x in out]


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """(s, p, o, o_kind, datatype, lang) of Turtle files whose blocks are parted by blank lines; the union of files is a set.

    The prefixes of each file's lines are read first (a few lines a file); blocks
    are then parsed where they lie, each by itself. Collections are not read.
    """
    lines = spark.read.text(list(paths)).where(F.lower(F.ltrim("value")).rlike("^(?:@prefix|prefix)\\s"))
    prefixes = {a: b for r in lines.distinct().collect() for a, b in _PREFIX.findall(r.value)}
    blocks = spark.read.option("lineSep", "\n\n").text(list(paths)).where(F.length(F.trim("value")) > 0)

    def run(batches):
        for b in batches:
            rows = [t for x in b["value"] for t in parse_turtle(_PREFIX.sub("", x), prefixes)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind", "datatype", "lang"])

    return blocks.mapInPandas(run, "s string, p string, o string, o_kind string, datatype string, lang string").distinct()


def write_turtle(t: DataFrame, path: str) -> None:
    """One block a subject, sorted, full addresses: the same graph gives the same text. A subject's triples bound its block."""
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "blank", F.col("o")).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'), F.coalesce(F.concat(F.lit("@"), "lang"), F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit(""))))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    each = t.select(subject.alias("s"), F.concat(F.lit("<"), "p", F.lit("> "), obj).alias("x")).distinct()
    block = each.groupBy("s").agg(F.concat(F.col("s"), F.lit(" "), F.array_join(F.array_sort(F.collect_list("x")), " ;\n    "), F.lit(" .\n")).alias("value"))
    block.repartitionByRange("s").sortWithinPartitions("s").select("value").write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with a header, quoted fields over several lines allowed; the schema is stated, never guessed."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, synonyms) of a JSON graph: props, provenance and context flattened with their prefixes."""
    g = spark.read.option("multiLine", True).json(path)

    def flat(df: DataFrame, groups: dict[str, str]) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            if f.name in groups and isinstance(f.dataType, StructType):
                cols += [F.col(f"{f.name}.{x}").alias(f"{groups[f.name]}_{x}") for x in f.dataType.names]
            else:
                cols.append(F.col(f.name))
        return df.select(*cols)

    part = lambda name: g.select(F.explode(name).alias("x")).select("x.*")
    nodes = flat(part("nodes"), {"props": "props", "provenance": "prov"})
    edges = flat(part("edges"), {"context_modifiers": "ctx", "provenance": "prov"})
    return nodes, edges, part("synonyms") if "synonyms" in g.columns else nodes.sparkSession.createDataFrame([], "node_id string, term string, lang string")


def read_concordance(spark: SparkSession, path: str, row: str = "concordance") -> DataFrame:
    """The rows of XML concordances inside zip archives, attributes and leaf elements as a map: each archive is opened in one task."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    def run(batches):
        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for inner in sorted(x for x in z.namelist() if x.lower().endswith(".xml")):
                        for _, e in ET.iterparse(z.open(inner)):
                            if e.tag.rsplit("}", 1)[-1] == row:
                                out.append((f"{name.rsplit('/', 1)[-1]}!{inner}", dict(e.attrib) | {c.tag.rsplit("}", 1)[-1]: c.text for c in e if c.text}))
                                e.clear()
            yield pd.DataFrame(out, columns=["source_file", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "source_file string, fields map<string,string>")
