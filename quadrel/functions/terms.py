"""RDF terms as columns, IRI building and text normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/",
    "dcterms": "http://purl.org/dc/terms/", "prov": "http://www.w3.org/ns/prov#", "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "void": "http://rdfs.org/ns/void#", "sh": "http://www.w3.org/ns/shacl#", "kg": "urn:kg:",
}
NUMERIC = [XSD + k for k in ("integer", "decimal", "double", "float", "nonNegativeInteger", "int", "long", "positiveInteger")]
#: A term: kind is uri, literal or bnode; lang and dt are '' where there is none.
TERM = T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "value", "lang", "dt")])


def term(kind: Column | str, value: Column, lang: Column | str = "", dt: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), value.alias("value"), lit(lang).alias("lang"), lit(dt).alias("dt"))


def escaped(text: Column) -> Column:
    """Percent-encode the characters that an IRI may not hold; all other Unicode stays."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in ' <>"{}|\\^`?#[]':
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    for c in range(1, 32):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return out


def clean_title(title: Column) -> Column:
    """Without soft hyphens, zero-width characters, word joiners and byte order marks; white space runs as one blank."""
    bare = F.regexp_replace(title, r"[\u00AD\u200B-\u200D\u2060\uFEFF]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def resource_iri(base: str, title: Column) -> Column:
    """base + resource/ + the title with its first letter in upper case, blanks as _ and the rest escaped."""
    return F.concat(F.lit(base + "resource/"), escaped(F.replace(first_upper(clean_title(title)), F.lit(" "), F.lit("_"))))


def norm_template(name: Column) -> Column:
    """Template names: no namespace, _ and blank runs as one blank, first letter in upper case."""
    bare = F.regexp_replace(name, r"(?iu)^\s*(?:template|bản mẫu|tiêu bản)\s*:", "")
    return first_upper(F.trim(F.regexp_replace(bare, r"(?U)[_\s]+", " ")))


def norm_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[_\s]+", " ")))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed form; ASCII texts never reach Python's normaliser's slow path."""
    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(_nfc(text))


def _accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, U+00C0 to U+1EF9, and their base letters."""
    pairs = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1EFA)):
        d = unicodedata.normalize("NFD", chr(c))
        base = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if len(d) > 1 and len(base) == 1:
            pairs[chr(c)] = base
    pairs |= {"đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Without accents, in lower case; native, as the letters concerned are finitely many."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}", ""), *_accents()))


def fold_name(text: Column) -> Column:
    """fold() without bracketed parts and with nothing but a-z, 0-9 and single blanks."""
    bare = F.regexp_replace(fold(text), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " "))


def compact(iri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """prefix:name where a known prefix fits."""
    out = iri
    for name, base in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(iri, F.lit(base)), F.concat(F.lit(name + ":"), F.substring(iri, len(base) + 1, 1 << 30))).otherwise(out)
    return out
