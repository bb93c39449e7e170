"""Matching entities of two sets of triples: assembly, name variants, measures, links, and reports on them.

Every step is a table: entities (one row each), names (one row a name), variants (one row a comparable form with its weight), so the only
join that grows is that of distinct variants within a block."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.terms import RDF, RDFS, fold_name
from quadrel.operators import linking

FOAF, GEO = "http://xmlns.com/foaf/0.1/", "http://www.w3.org/2003/01/geo/wgs84_pos#"

# Words without weight in names by block, ordered translations of terms, weights of kinds of names.
GENERIC = {
    "place": "tinh|thanh pho|tp|province|city|municipality|of|vietnam|viet nam".split("|"),
    "univ": "the|of|in|and|va|truong|dai hoc|hoc vien|university|academy|institute|college|school|vietnam|viet nam".split("|"),
}
GLOSSARY = [
    ("thanh pho ho chi minh", "ho chi minh city"), ("ha noi", "hanoi"), ("tp hcm", "ho chi minh city"),
    ("dai hoc quoc gia", "vnu national"), ("quoc gia", "national"), ("quoc te", "international"),
    ("su pham ky thuat", "technology education"), ("su pham", "education"),
    ("bach khoa", "science technology"), ("khoa hoc tu nhien", "natural sciences"),
    ("khoa hoc xa hoi va nhan van", "social sciences humanities"), ("kinh te quoc dan", "national economics"),
    ("kinh te", "economics"), ("luat", "law"), ("y duoc", "medicine pharmacy"), ("y te cong cong", "public health"),
    ("duoc", "pharmacy"), ("ngoai ngu", "foreign languages"), ("ngoai thuong", "foreign trade"),
    ("thuong mai", "commerce"), ("xay dung", "civil engineering"), ("kien truc", "architecture"),
    ("giao thong van tai", "transport"), ("hang hai", "maritime"), ("thuy loi", "water resources thuyloi"),
    ("nong lam", "agriculture forestry"), ("nong nghiep", "agriculture"), ("lam nghiep", "forestry"),
    ("tai nguyen va moi truong", "natural resources environment"), ("the duc the thao", "sport"),
    ("san khau dien anh", "theatre cinema"), ("my thuat", "fine arts"), ("am nhac", "music"),
    ("van hoa", "culture"), ("ngan hang", "banking"), ("tai chinh", "finance"), ("marketing", "marketing"),
    ("cong nghe thong tin", "information technology"), ("cong nghiep", "industry"), ("cong nghe", "technology"),
    ("khoa hoc", "science"), ("buu chinh vien thong", "posts telecommunications"), ("mo dia chat", "mining geology"),
    ("dien luc", "electric power"), ("ngoai giao", "diplomatic"), ("bao chi va tuyen truyen", "journalism communication"),
    ("chinh tri", "politics"), ("hanh chinh", "administration"), ("an ninh", "security"), ("canh sat", "police"),
    ("quan y", "military medical"), ("ky thuat", "technical engineering"), ("mo", "open"), ("y", "medical"),
    ("viet duc", "vietnamese german"), ("viet nhat", "vietnam japan"), ("viet phap", "vietnam france"),
]
MAIN, REDIRECT, SECONDARY = 1.0, 0.9, 0.8
#: Factors for a name cut at its comma, one that is only a place, and a pair that names different places.
CUT, PLACE_ONLY, PLACES_DIFFER = 0.9, 0.9, 0.7
#: Kilometres within which places are one.
NEAR_KM = {"univ": 2.0, "place": 15.0}
#: Most words of a place's name.
PLACE_WORDS = 6


@dataclass
class Rules:
    """blocks: class -> block; kinds: class -> kinds its counterpart may have; alt_names, dates: the properties of other names and of
    foundation, of the latter the first that gives a year; institution: the block whose names are translated and cut and whose years count."""

    blocks: dict[str, str]
    kinds: dict[str, list[str]] = field(default_factory=dict)
    generic: dict[str, list[str]] = field(default_factory=lambda: GENERIC)
    glossary: list[tuple[str, str]] = field(default_factory=lambda: GLOSSARY)
    near_km: dict[str, float] = field(default_factory=lambda: NEAR_KM)
    alt_names: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    institution: str = "univ"
    place: str = "place"


def translated(key: Column, glossary: list[tuple[str, str]]) -> Column:
    for a, b in glossary:
        key = F.regexp_replace(key, rf"\b{a}\b", b)
    return F.trim(F.regexp_replace(key, " +", " "))


def _bare(key: Column, generic: list[str]) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(key, r"\b(?:" + "|".join(generic) + r")\b", " "), " +", " "))


def _by_block(block: Column, rules: Rules, what) -> Column:
    return reduce(lambda out, b: out.when(block == b, what(b)), rules.generic, F.when(F.lit(False), F.lit(None)))


def noise(name: Column) -> Column:
    """Fragments and numbers: blank, beginning with a small letter, or nothing but digits and marks between them."""
    first = F.substring(name, 1, 1)
    return (name == "") | ((first == F.lower(first)) & (first != F.upper(first))) | name.rlike(r"^[\d.\s/-]+$")


def entities(triples: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(entities, names) of triples (s, p, o, o_kind, o_lang): entities are s, cls, block, homepages, lat, lon, years; names are s, block,
    name, weight, local (in our language). Of several classes the least counts; values are unions over all triples."""
    table = [(c, b) for c, b in rules.blocks.items()]
    kinds = triples.sparkSession.createDataFrame(table, "o string, block string")
    typed = triples.where(F.col("p") == RDF + "type").join(F.broadcast(kinds), "o").groupBy("s").agg(F.min(F.struct(F.col("o").alias("cls"), "block")).alias("t"))
    typed = typed.select("s", "t.cls", "t.block")
    host = F.when(F.col("p") == FOAF + "homepage", linking.domain(F.when(F.contains("o", F.lit("//")), F.col("o")).otherwise(F.concat(F.lit("http://"), F.col("o")))))
    year = F.when(F.col("p").isin(rules.dates), linking.year_of(F.col("o")))
    number = lambda p: F.min(F.when(F.col("p") == p, F.col("o").try_cast("double")))
    facts = triples.groupBy("s").agg(F.collect_set(F.nullif(host, F.lit(""))).alias("homepages"), number(GEO + "lat").alias("lat"), number(GEO + "long").alias("lon"), F.array_compact(F.array(F.min(F.when(year.isNotNull(), F.struct(F.array_position(F.array(*map(F.lit, rules.dates or [""])), F.col("p")).alias("at"), year.alias("y"))))["y"])).alias("years"))
    kind = F.when(F.col("p") == RDFS + "label", MAIN).when(F.col("p").isin(rules.alt_names), SECONDARY)
    local = (F.col("p") != RDFS + "label") | (F.coalesce("o_lang", F.lit("")) != "en")
    names = triples.select("s", F.trim("o").alias("name"), kind.alias("weight"), local.alias("local")).where("weight IS NOT NULL").distinct()
    return typed.join(facts, "s"), names.join(typed.select("s", "block"), "s")


def candidates(found: DataFrame, details: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The same for the other side: found (u, block, kind), details (u, field, value) with fields name, alt_name, redirect, homepage, lat,
    long and year, as recorded from an endpoint. Entities carry kinds; the name of the IRI below base is a name too."""
    unquoted = lambda c: F.replace(F.url_decode(F.replace(F.substring(c, len(base) + 1, 1 << 30), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    ours = found.where(F.startswith("u", F.lit(base)) & ~F.contains("u", F.lit("Category:"))).groupBy("u").agg(F.min("block").alias("block"), F.collect_set("kind").alias("kinds"))
    value = lambda f: F.when(F.col("field") == f, F.col("value"))
    host = linking.domain(F.when(F.contains("value", F.lit("//")), F.col("value")).otherwise(F.concat(F.lit("http://"), F.col("value"))))
    facts = details.groupBy("u").agg(
        F.collect_set(F.when(F.col("field") == "homepage", F.nullif(host, F.lit("")))).alias("homepages"), F.min(value("lat").try_cast("double")).alias("lat"),
        F.min(value("long").try_cast("double")).alias("lon"), F.collect_set(linking.year_of(value("year"))).alias("years"),
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    all_ = ours.join(facts, "u", "left").withColumns({"homepages": F.coalesce("homepages", none("string")), "years": F.coalesce("years", none("int"))})
    weight = F.when(F.col("field") == "name", MAIN).when(F.col("field") == "redirect", REDIRECT).when(F.col("field") == "alt_name", SECONDARY)
    said = details.select("u", F.when(F.col("field") == "redirect", unquoted(F.col("value"))).otherwise(F.col("value")).alias("name"), weight.alias("weight")).where("weight IS NOT NULL")
    said = said.unionByName(ours.select("u", unquoted(F.col("u")).alias("name"), F.lit(MAIN).alias("weight")))
    names = said.select("u", F.trim("name").alias("name"), "weight").groupBy("u", "name").agg(F.max("weight").alias("weight"))
    return all_, names.join(ours.select("u", "block"), "u").withColumn("local", F.lit(False))


def places(names: DataFrame, rules: Rules) -> DataFrame:
    """place: the keys of names of places, translated ones too."""
    of = names.where((F.col("block") == rules.place) & (F.col("weight") == MAIN))
    key = fold_name(F.col("name"))
    generic = rules.generic[rules.place]
    both = F.array(_bare(key, generic), _bare(translated(key, rules.glossary), generic))
    return of.select(F.explode(both).alias("place")).where("place <> ''").distinct()


def variants(names: DataFrame, known_places: DataFrame, rules: Rules, key: str = "s") -> DataFrame:
    """(key, block, form, weight): comparable forms of names. A better kind of name counts before the weight of the form."""
    institution = F.col("block") == rules.institution
    cut = F.when(institution & F.contains("name", F.lit(",")), F.struct(F.split_part("name", F.lit(","), F.lit(1)).alias("h"), F.lit(CUT).alias("f")))
    heads = names.where(~noise(F.col("name"))).select(key, "block", "local", "weight", F.explode(F.array_compact(F.array(F.struct(F.col("name").alias("h"), F.lit(1.0).alias("f")), cut))).alias("x"))
    plain = fold_name(F.col("x.h"))
    bare = lambda c: _by_block(F.col("block"), rules, lambda b: _bare(c, rules.generic[b]))
    forms = F.array_compact(F.array(bare(plain), F.when(institution & F.col("local"), bare(translated(plain, rules.glossary)))))
    rows = heads.select(key, "block", "weight", F.col("x.f").alias("f"), F.explode(F.array_distinct(forms)).alias("form")).where("form <> ''")
    rows = rows.join(known_places.select(F.col("place").alias("form"), F.lit(True).alias("is_place")), "form", "left")
    worth = F.col("weight") * F.col("f") * F.when(institution & F.coalesce("is_place", F.lit(False)), PLACE_ONLY).otherwise(1.0)
    best = rows.groupBy(key, "block", "form").agg(F.max(F.struct(F.col("weight").alias("kind"), worth.alias("worth"))).alias("b"))
    return best.select(key, "block", "form", F.col("b.worth").alias("weight"))


def mentions(names: DataFrame, known_places: DataFrame, rules: Rules, key: str = "s") -> DataFrame:
    """(key, places): the places named in the main names of institutions, found by their runs of words."""
    text = translated(fold_name(F.col("name")), rules.glossary)
    words = names.where((F.col("block") == rules.institution) & (F.col("weight") == MAIN)).select(key, F.split(text, " +").alias("w"))
    starts = words.select(key, "w", F.posexplode("w").alias("i", "_")).drop("_")
    runs = starts.select(key, F.explode(F.sequence(F.lit(1), F.least(F.lit(PLACE_WORDS), F.size("w") - F.col("i")))).alias("n"), "w", "i")
    found = runs.select(key, F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("place")).distinct().join(known_places, "place", "left_semi")
    return found.groupBy(key).agg(F.collect_set("place").alias("places"))


def scored(ours: tuple[DataFrame, DataFrame], theirs: tuple[DataFrame, DataFrame], rules: Rules) -> DataFrame:
    """s, u, cls, name, type, homepage, geo, year, score of the pairs within a block that have a score of linking.KEPT or more."""
    (a, a_names), (b, b_names) = ours, theirs
    known = places(a_names, rules)
    left, right = variants(a_names, known, rules), variants(b_names, known, rules, "u")
    forms = left.select("block", F.col("form").alias("x")).distinct().join(right.select("block", F.col("form").alias("y")).distinct(), "block")
    alike = forms.withColumn("sim", linking.name_similarity(F.col("x"), F.col("y"))).where("sim > 0")
    both = alike.join(left.select("block", F.col("form").alias("x"), "s", F.col("weight").alias("wx")), ["block", "x"]).join(right.select("block", F.col("form").alias("y"), "u", F.col("weight").alias("wy")), ["block", "y"])
    name = both.groupBy("s", "u").agg(F.max(F.col("sim") * F.col("wx") * F.col("wy")).alias("name"))
    here, there = mentions(a_names, known, rules), mentions(b_names, known, rules, "u").withColumnRenamed("places", "places2")
    name = name.join(here, "s", "left").join(there, "u", "left")
    differ = F.coalesce(~F.arrays_overlap("places", "places2"), F.lit(False))
    name = name.select("s", "u", (F.col("name") * F.when(differ, PLACES_DIFFER).otherwise(1.0)).alias("name"))
    c = b.withColumnsRenamed({"homepages": "homepages2", "lat": "lat2", "lon": "lon2", "years": "years2"}).drop("block")
    pairs = a.join(name, "s").join(c, "u")
    expected = reduce(lambda out, k: out.when(F.col("cls") == k, F.when(F.arrays_overlap("kinds", F.array(*map(F.lit, rules.kinds[k]))), 1.0).otherwise(0.0)), rules.kinds, F.when(F.lit(False), 0.0))
    near = reduce(lambda out, k: out.when(F.col("block") == k, F.lit(rules.near_km[k])), rules.near_km, F.when(F.lit(False), 0.0))
    km = linking.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    gap = F.array_min(F.flatten(F.transform("years", lambda x: F.transform("years2", lambda y: F.abs(x - y)))))
    measures = {
        "name": F.col("name"), "type": expected, "homepage": F.when(F.arrays_overlap("homepages", "homepages2"), 1.0), "geo": linking.geo_similarity(km, near),
        "year": F.when(F.col("block") == rules.institution, linking.year_similarity(gap, F.lit(0))),
    }
    out = pairs.select("s", "u", "cls", *(x.alias(k) for k, x in measures.items()))
    return out.withColumn("score", linking.weighted({k: F.col(k) for k in measures})).where(F.col("score") >= linking.KEPT)


def matched(pairs: DataFrame, threshold: float = linking.THRESHOLD) -> DataFrame:
    """The one-to-one pairs of scored() with sure: enough evidence for a link that nothing else confirms."""
    best = linking.assign(pairs.select("s", "u", "score")).select("s", "u").join(pairs, ["s", "u"]).where(F.col("score") >= threshold)
    return best.withColumn("sure", linking.confident(F.col("name"), [F.col(k) for k in ("type", "homepage", "geo", "year")]))


def united(*links: DataFrame) -> DataFrame:
    """Links (s, u) of several sets, each once."""
    return reduce(DataFrame.unionByName, [x.select("s", "u") for x in links]).distinct()


def coverage(typed: DataFrame, links: DataFrame) -> DataFrame:
    """cls, n, linked, rate of typed (s, cls): how many entities of a class have a link (s), largest classes first."""
    has = links.select("s").distinct().withColumn("_l", F.lit(1))
    out = typed.select("s", "cls").distinct().join(has, "s", "left").groupBy("cls").agg(F.count("*").alias("n"), F.count("_l").alias("linked"))
    return out.withColumn("rate", F.col("linked") / F.col("n")).orderBy(F.desc("n"), "cls")


def recall_ceiling(gold: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: gold (s, g) of our entities (s), how many have their target among the candidates (u), and the rate."""
    mine = gold.join(ours.select("s").distinct(), "s", "left_semi")
    seen = mine.join(theirs.select(F.col("u").alias("g")).distinct().withColumn("_c", F.lit(1)), "g", "left")
    return seen.agg(F.count("*").alias("gold"), F.count("_c").alias("reachable")).withColumn("rate", F.coalesce(F.try_divide("reachable", "gold"), F.lit(0.0)))


def errors(best: DataFrame, gold: DataFrame, theirs: DataFrame, threshold: float = linking.THRESHOLD) -> DataFrame:
    """s, u, g, kind of gold pairs (s, g) that best (s, u, score) misses: wrong (another target), no candidate, low score."""
    hit = best.where(F.col("score") >= threshold).select("s", "u")
    df = gold.select("s", "g").join(hit, "s", "left").join(theirs.select(F.col("u").alias("g")).distinct().withColumn("_c", F.lit(True)), "g", "left")
    kind = F.when(F.col("u").isNotNull(), "wrong").when(F.col("_c").isNull(), "no candidate").otherwise("low score")
    return df.where("u IS NULL OR u <> g").select("s", "u", "g", kind.alias("kind"))


def reviewed(review: DataFrame, by: str | None = None) -> DataFrame:
    """n, right, precision, low, high of review (right: 1 or 0, null where nobody has judged), per value of by."""
    done = review.where("right IS NOT NULL").groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.count_if(F.col("right") == 1).alias("right"))
    low, high = linking.wilson(F.col("right"), F.col("n"))
    return done.withColumns({"precision": F.coalesce(F.try_divide("right", "n"), F.lit(0.0)), "low": low, "high": high})
