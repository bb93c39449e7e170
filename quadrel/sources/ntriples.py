"""N-Triples and a subset of Turtle: scans and deterministic sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.terms import PREFIXES, RDF, XSD
from quadrel.operators.store import TRIPLE

# an object literal is the last quoted part of its line, so the loop over it needs no alternation (which would recurse on long texts)
# (?s): a text may hold line ends of Unicode, which a line of the file does not end at
_LINE = r'(?s)^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>"]*)>)?)\s*\.\s*(?:#[^"]*)?$'


def _unescaped(c: Column) -> Column:
    """The escapes of strings; the rare numeric ones are left to text that has them."""
    own, mark = F.lit("\u00000"), F.lit("\u00001")  # a U+0000 of the text and an escaped backslash
    out = F.replace(F.replace(c, F.lit("\u0000"), own), F.lit("\\\\"), mark)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(F.replace(out, mark, F.lit("\\")), own, F.lit("\u0000"))


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct triples of N-Triples files; comments and blank lines are skipped, other lines that do not parse raise an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    literal = F.col("value").rlike(r'^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+"')
    df = lines.select(
        F.when(F.col("value").rlike(_LINE), True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("boolean")).alias("ok"),
        F.concat(part(1), part(2)).alias("s"), part(3).alias("p"), F.when(literal, _unescaped(part(6))).otherwise(F.concat(part(4), part(5))).alias("o"),
        F.when(literal, "literal").when(part(5) != "", "bnode").otherwise("uri").alias("o_kind"), F.lower(part(7)).alias("o_lang"),
        F.when(literal & (part(7) == "") & (part(8) == ""), XSD + "string").otherwise(part(8)).alias("o_dt"),
    )
    return df.where("ok").select(TRIPLE).distinct()


def as_lines(triples: DataFrame) -> DataFrame:
    """value: one N-Triples line per triple, raw Unicode, with the escapes that strings need."""
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    suffix = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when((F.col("o_dt") != "") & (F.col("o_dt") != XSD + "string"), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(node(F.col("o")))
    return triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, files: int | None = None) -> None:
    """Distinct lines in code point order: over the files in name order as well as within each."""
    lines = as_lines(triples).distinct()
    (lines.orderBy("value") if files is None else lines.repartitionByRange(files, "value").sortWithinPartitions("value")).write.mode("overwrite").text(path)


_TTL = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<str>\"{3}.*?\"{3}|\"(?:[^\"\\\n]|\\.)*\")|(?P<at>@prefix|@base)|(?P<lang>@[A-Za-z-]+)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<pname>(?:[^\W\d_][\w-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?|_:\w+)|(?P<word>[A-Za-z]+)|(?P<op>\^\^|[.;,()\[\]])""",
    re.S,
)


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str, str]]:
    """Rows of TRIPLE for a small Turtle text (ontologies, shapes): prefixes, lists, blank nodes, literals."""
    tokens, pos = [], 0
    while pos < len(text):
        m = _TTL.match(text, pos)
        if not m:
            raise SyntaxError(f"unexpected {text[pos : pos + 30]!r}")
        pos = m.end()
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
    prefixes, base, out, at, blanks = dict(PREFIXES), "", [], 0, 0

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def peek(x: str) -> bool:
        return at < len(tokens) and tokens[at][1] == x

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:t{blanks}"

    def node() -> tuple[str, str, str, str]:
        kind, x = take()
        if kind == "iri":
            return (x[1:-1] if ":" in x else base + x[1:-1], "uri", "", "")
        if kind == "pname":
            if x.startswith("_:"):
                return (x, "bnode", "", "")
            name, _, local = x.partition(":")
            return (prefixes[name] + local, "uri", "", "")
        if kind == "num":
            return (x, "literal", "", XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
        if kind == "str":
            n = 3 if x.startswith('"""') else 1
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), x[n:-n])
            if at < len(tokens) and tokens[at][0] == "lang":
                return (value, "literal", take()[1][1:].lower(), "")
            if peek("^^"):
                take()
                return (value, "literal", "", node()[0])
            return (value, "literal", "", XSD + "string")
        if x == "[":
            b = blank()
            if not peek("]"):
                predicates(b)
            take()
            return (b, "bnode", "", "")
        if x == "(":
            items = []
            while not peek(")"):
                items.append(node())
            take()
            head = (RDF + "nil", "uri", "", "")
            for item in reversed(items):
                cell = blank()
                out.append((cell, RDF + "first", *item))
                out.append((cell, RDF + "rest", *head))
                head = (cell, "bnode", "", "")
            return head
        if x in ("true", "false"):
            return (x, "literal", "", XSD + "boolean")
        raise SyntaxError(f"unexpected {x!r}")

    def predicates(s: str) -> None:
        while True:
            if tokens[at] == ("word", "a"):
                take()
                p = RDF + "type"
            else:
                p = node()[0]
            while True:
                out.append((s, p, *node()))
                if not peek(","):
                    break
                take()
            if not peek(";"):
                return
            while peek(";"):
                take()
            if peek(".") or peek("]"):
                return

    while at < len(tokens):
        kind, x = tokens[at]
        if kind == "at" or kind == "word" and x.upper() in ("PREFIX", "BASE"):
            take()
            if x.lower().endswith("base"):
                base = take()[1][1:-1]
            else:
                name = take()[1][:-1]
                prefixes[name] = take()[1][1:-1]
            if peek("."):
                take()
            continue
        s = node()[0]
        if not peek("."):
            predicates(s)
        take()
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A small Turtle file, read by Spark as one text and parsed on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(parse_turtle(text), ", ".join(f"{c} string" for c in TRIPLE)).distinct()


def turtle(triples: DataFrame, most: int = 100_000) -> str:
    """Turtle of a small graph, subjects and predicates in code point order; larger graphs are refused."""
    rows = sorted(map(tuple, triples.select(TRIPLE).distinct().limit(most + 1).collect()))
    if len(rows) > most:
        raise ValueError(f"more than {most} triples; write N-Triples instead")
    out, last = [], None
    for s, p, o, kind, lang, dt in rows:
        text = o.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        obj = o if o.startswith("_:") and kind == "bnode" else f"<{o}>" if kind == "uri" else f'"{text}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt and dt != XSD + "string" else "")
        if s == last:
            out[-1] = out[-1][:-2] + f" ;\n    <{p}> {obj} ."
        else:
            out.append((s if s.startswith("_:") else f"<{s}>") + f" <{p}> {obj} .")
        last = s
    return "\n".join(out) + "\n"
