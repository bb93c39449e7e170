"""Results in exchange formats, and query files.

Rows are turned into lines by expressions, so a result of any size is written as it is computed; the texts of whole documents (JSON, XML)
are for results that fit the driver and are refused beyond MOST rows."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions.terms import XSD
from quadrel.plans import sparql

MOST = 100_000
_SPARQL = "http://www.w3.org/2005/sparql-results#"


def _names(df: DataFrame) -> list[str]:
    """The columns that hold terms (structs of kind, value, lang, dt)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]


def _binding(c: Column) -> Column:
    """A term as an object of the JSON format; unbound ones are left out of their row."""
    lang, dt = F.nullif(c["lang"], F.lit("")), F.nullif(F.nullif(c["dt"], F.lit("")), F.lit(XSD + "string"))
    return F.when(c.isNotNull(), F.struct(c["kind"].alias("type"), c["value"].alias("value"), lang.alias("xml:lang"), dt.alias("datatype")))


def json_lines(df: DataFrame) -> DataFrame:
    """value: one JSON object of bindings a row."""
    return df.select(F.to_json(F.struct(*(_binding(F.col(n)).alias(n) for n in _names(df)))).alias("value"))


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows; write lines instead")
    return rows


def as_json(df: DataFrame) -> str:
    """The SPARQL JSON results of a SELECT (terms) or an ASK (one boolean, ask)."""
    if df.columns == ["ask"]:
        return json.dumps({"head": {}, "boolean": bool(df.first()[0])})
    names = _names(df)
    rows = ",".join(r[0] for r in _bounded(json_lines(df)))
    return f'{{"head": {json.dumps({"vars": names})}, "results": {{"bindings": [{rows}]}}}}'


def as_xml(df: DataFrame) -> str:
    """The SPARQL XML results."""
    head = f'<?xml version="1.0"?>\n<sparql xmlns="{_SPARQL}">'
    if df.columns == ["ask"]:
        return f"{head}<head/><boolean>{str(bool(df.first()[0])).lower()}</boolean></sparql>"
    names, out = _names(df), [head, "<head>", *(f"<variable name={quoteattr(n)}/>" for n in _names(df)), "</head><results>"]
    for row in _bounded(df.select(*names)):
        out.append("<result>")
        for n in names:
            if (t := row[n]) is not None:
                if t["kind"] == "literal":
                    extra = f" xml:lang={quoteattr(t['lang'])}" if t["lang"] else f" datatype={quoteattr(t['dt'])}" if t["dt"] and t["dt"] != XSD + "string" else ""
                    body = f"<literal{extra}>{escape(t['value'])}</literal>"
                else:
                    body = f"<{t['kind']}>{escape(t['value'])}</{t['kind']}>"
                out.append(f"<binding name={quoteattr(n)}>{body}</binding>")
        out.append("</result>")
    return "".join([*out, "</results></sparql>"])


def plain(df: DataFrame) -> DataFrame:
    """The values of the terms as columns, for CSV writers."""
    return df.select(*(F.col(n)["value"].alias(n) for n in _names(df)))


def write_csv(df: DataFrame, path: str) -> None:
    """The SPARQL CSV results: a folder of files with a header each."""
    plain(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def query_files(folder: str) -> list[tuple[str, str, str]]:
    """(name, title, text) of the .rq files of a folder in order of their names; the title is the first line if that is a comment."""
    out = []
    for path in sorted(Path(folder).glob("*.rq")):
        text = path.read_text(encoding="utf-8")
        first = text.lstrip("\ufeff").split("\n", 1)[0].strip()
        out.append((path.stem, first.lstrip("# ").strip() if first.startswith("#") else path.stem, text))
    return out


def report(store, folder: str, most: int = 15, services: dict | None = None) -> str:
    """A Markdown report of the query files of a folder: title, number of rows, the first of them."""
    from quadrel.sources.files import markdown

    parts = []
    for name, title, text in query_files(folder):
        df = sparql.rows(store, text, services)
        parts.append(f"## {name}: {title}\n\n{df.count()} rows\n\n{markdown(df, most)}\n")
    return "\n".join(parts)
