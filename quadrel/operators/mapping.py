"""Mapping-driven extraction: articles and a declarative mapping -> typed triples in datasets, coverage, rejections.

A mapping is a dict (or YAML text) with base, templates {name: {class_rules, properties {param: rule or rules}}},
no_infobox_rules and skip_raw_params. A class rule has any of source_category, title_in, title_prefix, title_contains
and a class, null meaning: stop, untyped. A property rule has parser, property and any of datatype, lang, year_property, object, iri,
individual, target_class, target_prefix, routes, text_fallback."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions import parsers, wikitext
from quadrel.functions.terms import RDF, RDFS, XSD, clean_title, norm_key, resource_iri
from quadrel.operators.state import settled, spread, unique

_PARSED = "boxes array<struct<ord: int, template: string, params: array<struct<ord: int, name: string, raw: string>>>>, links array<struct<target: string, shown: string>>, categories array<string>, lead string"


def load(text: str) -> dict:
    """A mapping from YAML, anchors and merge keys included."""
    import yaml

    return yaml.safe_load(text)


def parse_articles(articles: DataFrame) -> DataFrame:
    """articles with boxes, links, categories and lead from the column text, in Arrow batches. Parsed once, by all cores, and written: every layer
    and every dataset reads the table."""

    @F.pandas_udf("struct<" + _PARSED.replace("boxes array", "boxes: array").replace("links array", "links: array").replace("categories array", "categories: array").replace("lead string", "lead: string") + ">")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            boxes = [{"ord": i, "template": n, "params": [{"ord": k, "name": a, "raw": b} for k, (a, b) in enumerate(ps.items())]} for i, (n, ps) in enumerate(wikitext.infoboxes(t))]
            found = [{"target": a, "shown": b} for a, b in wikitext.links(t)]
            rows.append({"boxes": boxes, "links": found, "categories": wikitext.categories(t), "lead": wikitext.lead(t)})
        return pd.DataFrame(rows, columns=["boxes", "links", "categories", "lead"])

    return settled(spread(articles, "id").withColumn("_p", run("text")).select(*articles.columns, "_p.*"))


def rule_condition(rule: dict, title: Column, categories: Column) -> Column:
    """All conditions of a class rule that are given."""
    tests = []
    if rule.get("source_category"):
        tests.append(F.array_contains(categories, rule["source_category"]))
    if rule.get("title_in"):
        tests.append(title.isin(rule["title_in"]))
    if rule.get("title_prefix"):
        tests.append(F.startswith(F.lower(title), F.lit(rule["title_prefix"].lower())))
    if rule.get("title_contains"):
        tests.append(F.contains(F.lower(title), F.lit(rule["title_contains"].lower())))
    return reduce(Column.__and__, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def first_rule(rules: list[dict], title: Column, categories: Column) -> Column:
    """struct(hit, cls) of the first rule that holds; a null class is a hit too."""
    none = F.struct(F.lit(False).alias("hit"), F.lit(None).cast("string").alias("cls"))
    if not rules:
        return none
    out = None
    for r in rules:
        value = F.struct(F.lit(True).alias("hit"), F.lit(r.get("class")).cast("string").alias("cls"))
        test = rule_condition(r, title, categories)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(none)


def classify(parsed: DataFrame, mapping: dict) -> DataFrame:
    """parsed (with title, boxes and source_categories) plus cls: the first mapped template with a hit decides, even for null;
    without a mapped template no_infobox_rules do."""
    title, cats = F.col("title"), F.col("source_categories")
    names = list(mapping["templates"])
    known = F.filter("boxes", lambda b: b["template"].isin(names))
    per = {n: first_rule(t.get("class_rules") or [], title, cats) for n, t in mapping["templates"].items()}

    def of(b):
        out = F.when(F.lit(False), first_rule([], title, cats))
        for n, c in per.items():
            out = out.when(b["template"] == n, c)
        return out

    hits = F.filter(F.transform(known, of), lambda h: h["hit"])
    free = first_rule(mapping.get("no_infobox_rules") or [], title, cats)
    cls = F.when(F.size(known) == 0, free["cls"]).otherwise(F.get(hits, F.lit(0))["cls"])
    return parsed.withColumn("cls", cls)


def _out(df: DataFrame, dataset: str, p: Column, o: Column, kind: Column | str = "uri", lang: str = "", dt: Column | str = "", s: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    cols = [F.lit(dataset).alias("dataset"), (F.col("s") if s is None else s).alias("s"), p.alias("p"), o.alias("o"), lit(kind).alias("o_kind"), F.lit(lang).alias("o_lang"), lit(dt).alias("o_dt")]
    return df.select(*cols).where("s IS NOT NULL AND o IS NOT NULL")


def common_layer(parsed: DataFrame, base: str, wiki: str, lang: str = "vi") -> DataFrame:
    """labels, abstracts, categories, page-links and provenance of classified articles."""
    a = parsed.withColumn("s", resource_iri(base, F.col("title")))
    abstract = a.where("lead <> ''")
    cats = a.select("s", F.explode(F.array_distinct("categories")).alias("c"))
    hrefs = a.select("s", F.explode(F.array_distinct(F.transform("links", lambda x: x["target"]))).alias("t"))
    revision = a.where("revision_id IS NOT NULL")
    source = F.concat(F.lit(wiki), F.replace("title", F.lit(" "), F.lit("_")))
    version = F.concat(source, F.lit("?oldid="), F.col("revision_id").cast("string"))
    lit = F.lit
    out = [
        _out(a, "labels", lit(RDFS + "label"), F.col("title"), "literal", lang),
        _out(abstract, "abstracts", lit(RDFS + "comment"), F.col("lead"), "literal", lang),
        _out(cats, "categories", lit("http://purl.org/dc/terms/subject"), F.concat(lit(base + "resource/Thể_loại:"), F.replace("c", lit(" "), lit("_")))),
        _out(hrefs, "page-links", lit(base + "ontology/wikiPageWikiLink"), resource_iri(base, F.col("t"))),
        _out(a, "provenance", lit("http://xmlns.com/foaf/0.1/isPrimaryTopicOf"), source),
        _out(a, "provenance", lit(base + "ontology/wikiPageID"), F.col("id").cast("string"), "literal", "", XSD + "integer"),
        _out(revision, "provenance", lit("http://www.w3.org/ns/prov#wasDerivedFrom"), version),
        _out(revision, "provenance", lit(base + "ontology/wikiPageRevisionID"), F.col("revision_id").cast("string"), "literal", "", XSD + "integer"),
        _out(revision.where("revision_timestamp IS NOT NULL"), "provenance", lit("http://www.w3.org/ns/prov#generatedAtTime"), F.col("revision_timestamp"), "literal", "", XSD + "dateTime", s=version),
        _out(a.where("cls IS NOT NULL"), "instance-types", lit(RDF + "type"), F.col("cls")),
    ]
    return unique(reduce(DataFrame.unionByName, out))


def long_params(parsed: DataFrame, last_of_template: bool) -> DataFrame:
    """(s, id, title, template, param, raw), blank ones left out; last_of_template: only the last box of equal names."""
    boxes = parsed.select("s", "id", "title", F.explode("boxes").alias("b"), F.col("boxes").alias("all"))
    if last_of_template:
        boxes = boxes.where("b.ord = array_max(transform(filter(all, x -> x.template = b.template), x -> x.ord))")
    rows = boxes.select("s", "id", "title", F.col("b.template").alias("template"), F.explode("b.params").alias("x"))
    return rows.select("s", "id", "title", "template", F.col("x.name").alias("param"), F.col("x.raw").alias("raw")).where("trim(raw) <> ''")


@F.pandas_udf(T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))
def _raw_value(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{"links": [t for t, _ in wikitext.links(x)], "text": wikitext.plain(x)[:500]} for x in s], columns=["links", "text"])


def raw_layer(parsed: DataFrame, base: str, skip: list[str] = (), lang: str = "vi") -> DataFrame:
    """infobox-properties: links of a parameter if it has any, else its text up to 500 characters."""
    a = long_params(parsed.withColumn("s", resource_iri(base, F.col("title"))), False).where(~F.col("param").isin(list(skip)))
    a = settled(a.withColumn("v", _raw_value("raw"))).withColumn("p", F.concat(F.lit(base + "property/"), F.replace("param", F.lit(" "), F.lit("_"))))
    linked = a.where("size(v.links) > 0").select("s", "p", F.explode("v.links").alias("t"))
    texts = a.where("size(v.links) = 0 AND v.text <> ''")
    return unique(_out(linked, "infobox-properties", F.col("p"), resource_iri(base, F.col("t"))).unionByName(_out(texts, "infobox-properties", F.col("p"), F.col("v.text"), "literal", lang)))


def anchors(parsed: DataFrame) -> DataFrame:
    """(key, target, n, least id): surface forms of links, shown text and target alike."""
    links = parsed.select("id", F.explode("links").alias("l"))
    both = links.select("id", F.col("l.target").alias("target"), F.explode(F.array_distinct(F.array("l.shown", "l.target"))).alias("form"))
    return both.select("id", "target", norm_key(F.col("form")).alias("key")).where("key <> ''").groupBy("key", "target").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def resolve(texts: DataFrame, titles: DataFrame, forms: DataFrame, prefix: str = r"^(?:tỉnh|thành phố|trường)\s+") -> DataFrame:
    """texts (key) plus target: exact title, else the most frequent anchor target (ties: first seen), then both for the key without its
    generic prefix."""
    by_title = titles.groupBy(norm_key(F.col("title")).alias("k")).agg(F.min("title").alias("t"))
    by_anchor = forms.groupBy(F.col("key").alias("k")).agg(F.min_by("target", F.struct(-F.col("n"), "first", "target")).alias("t"))
    df = texts.withColumn("bare", F.regexp_replace("key", prefix, ""))
    for i, (table, key) in enumerate(((by_title, "key"), (by_anchor, "key"), (by_title, "bare"), (by_anchor, "bare"))):
        df = df.join(table.select(F.col("k").alias(key), F.col("t").alias(f"_t{i}")), key, "left")
    return df.withColumn("target", F.coalesce("_t0", "_t1", "_t2", "_t3")).drop("bare", "_t0", "_t1", "_t2", "_t3")


def routed(target: Column, routes: list[dict]) -> Column:
    """The property of the first route one of whose prefixes the target has."""
    out = None
    for r in routes:
        test = reduce(Column.__or__, [F.startswith(target, F.lit(p)) for p in r["target_prefix"]])
        out = F.when(test, r["property"]) if out is None else out.when(test, r["property"])
    return out


def mapping_layer(classified: DataFrame, mapping: dict, closure: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, rejected, coverage): the typed layer of a mapping.

    rejected: property, reason (route, prefix, class), n. coverage: template, param, has, ok, rate, examples (up to three that failed)."""
    base = mapping["base"]
    a = classified.withColumn("s", resource_iri(base, F.col("title")))
    params = long_params(a, True)
    mapped = [(t, p) for t, spec in mapping["templates"].items() for p in spec.get("properties") or {}]
    wanted = classified.sparkSession.createDataFrame(mapped, "template string, param string")
    # the markup of each mapped parameter is scanned once; rules read their own rows of the table
    params = settled(params.join(F.broadcast(wanted.distinct()), ["template", "param"], "left_semi").withColumn("m", parsers.scanned(F.col("raw"))))
    types = classified.where("cls IS NOT NULL").select(F.col("title").alias("t"), F.col("cls").alias("c"))
    reachable = types.join(closure, "c", "left").select("t", F.coalesce("super", "c").alias("c")).unionByName(types)
    titles, forms = classified.select("title"), anchors(classified)
    emitted, refused = [], []
    for template, spec in mapping["templates"].items():
        for param, rules in (spec.get("properties") or {}).items():
            for rule in rules if isinstance(rules, list) else [rules]:
                rows = params.where((F.col("template") == template) & (F.col("param") == param))
                values = rows.withColumn("vs", parsers.of(F.col("m"), rule["parser"]))
                if rule.get("text_fallback"):
                    values = _with_fallback(values, titles, forms)
                each = values.select("s", "id", "template", "param", F.explode("vs").alias("v"))
                good, bad = _emit(each, rule, base, reachable)
                emitted.append(good)
                refused += bad
    fields = "dataset string, s string, p string, o string, o_kind string, o_lang string, o_dt string, template string, param string"
    empty = classified.sparkSession.createDataFrame([], fields)
    out = reduce(DataFrame.unionByName, emitted, empty)
    triples = unique(out.drop("template", "param"))
    triples = triples.unionByName(_density(triples, mapping)) if mapping.get("density") else triples
    none = classified.sparkSession.createDataFrame([], "property string, reason string")
    rejected = reduce(DataFrame.unionByName, refused, none).groupBy("property", "reason").agg(F.count("*").alias("n"))
    ok = out.select("s", "template", "param").distinct().withColumn("ok", F.lit(1))
    seen = params.join(ok, ["s", "template", "param"], "left")
    place = F.row_number().over(Window.partitionBy("template", "param").orderBy("id", F.substring("raw", 1, 80)))
    failed = seen.where("ok IS NULL").withColumn("place", place).where("place <= 3").groupBy("template", "param")
    examples = failed.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("raw", 1, 80).alias("raw")))), lambda x: x["raw"]).alias("examples"))
    coverage = seen.groupBy("template", "param").agg(F.count("*").alias("has"), F.count("ok").alias("ok")).join(examples, ["template", "param"], "left")
    coverage = coverage.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return triples, rejected, coverage.withColumn("rate", F.round(F.col("ok") / F.col("has"), 4)).orderBy("template", F.desc("has"), "param")


def _with_fallback(values: DataFrame, titles: DataFrame, forms: DataFrame) -> DataFrame:
    """Where the parser found no link, the whole text, else its parts, are looked up as titles and anchors."""
    none = values.where("size(vs) = 0")
    whole = parsers.of(F.col("m"), "text")
    parts = parsers.of(F.col("m"), "text_list")
    forms_ = none.select("s", "id", "template", "param", F.posexplode(F.array_distinct(F.concat(F.transform(whole, lambda x: x["v"]), F.transform(parts, lambda x: x["v"])))).alias("pos", "text"))
    found = resolve(forms_.withColumn("key", norm_key(F.col("text"))), titles, forms).where("target IS NOT NULL")
    first = found.groupBy("s", "id", "template", "param").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("ts"))
    chosen = F.when(F.get("ts", F.lit(0))["pos"] == 0, F.slice("ts", 1, 1)).otherwise(F.col("ts"))
    vs = F.transform(F.array_distinct(F.transform(chosen, lambda x: x["target"])), lambda t: F.struct(t.alias("v"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("string").alias("kind")))
    return values.where("size(vs) > 0").select("s", "id", "template", "param", "vs").unionByName(first.select("s", "id", "template", "param", vs.alias("vs")))


def _emit(each: DataFrame, rule: dict, base: str, reachable: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    def out(df, dataset, p, o, kind="uri", dt=""):
        lang = rule.get("lang", "") if kind == "literal" else ""
        cols = {"dataset": F.lit(dataset), "s": F.col("s"), "p": p, "o": o, "o_kind": F.lit(kind), "o_lang": F.lit(lang), "o_dt": F.lit(dt)}
        return df.select(*(c.alias(k) for k, c in cols.items()), "template", "param").where("o IS NOT NULL")

    p = F.lit(rule["property"])
    v = F.col("v.v")
    if rule["parser"] == "coord":
        geo = "http://www.w3.org/2003/01/geo/wgs84_pos#"
        parts = [out(each, "geo-coordinates", F.lit(geo + k), F.round(F.col(f"v.{c}"), 6).cast("string"), "literal", XSD + "float") for k, c in (("lat", "lat"), ("long", "lon"))]
        return parts[0].unionByName(parts[1]), []
    if rule.get("individual"):
        return out(each, "mappingbased-objects", p, F.concat(F.lit(base + "ontology/"), v)), []
    if rule.get("object"):
        bad, name = [], rule["property"]
        refuse = lambda df, why: bad.append(df.select(F.lit(name).alias("property"), F.lit(why).alias("reason")))
        if rule.get("routes"):
            each = each.withColumn("route", routed(v, rule["routes"]))
            refuse(each.where("route IS NULL"), "route")
            each, p = each.where("route IS NOT NULL"), F.col("route")
        if rule.get("target_prefix"):
            fits = reduce(Column.__or__, [F.startswith(v, F.lit(x)) for x in rule["target_prefix"]])
            refuse(each.where(~fits), "prefix")
            each = each.where(fits)
        if rule.get("target_class"):
            right = reachable.where(F.col("c") == rule["target_class"]).select(F.col("t").alias("_t"))
            keyed = each.withColumn("_t", clean_title(v))
            refuse(keyed.join(right, "_t", "left_anti"), "class")
            each = keyed.join(right, "_t", "left_semi")
        return out(each, "mappingbased-objects", p, resource_iri(base, v)), bad
    if rule.get("iri"):
        return out(each, "mappingbased-objects", p, v), []
    if rule["parser"] == "date":
        day, year = each.where("v.kind = 'date'"), each.where("v.kind = 'gYear'")
        good = out(day, "mappingbased-literals", p, v, "literal", XSD + "date")
        if rule.get("year_property"):
            good = good.unionByName(out(year, "mappingbased-literals", F.lit(rule["year_property"]), v, "literal", XSD + "gYear"))
        return good, []
    return out(each, "mappingbased-literals", p, v, "literal", rule.get("datatype") or ("" if rule.get("lang") else XSD + "string")), []


def _density(triples: DataFrame, mapping: dict) -> DataFrame:
    """population / (area / 1e6), two digits, where an entity has both; density names the three properties."""
    d = mapping["density"]
    both = triples.groupBy("s").agg(*(F.max(F.when(F.col("p") == d[k], F.col("o").try_cast("double"))).alias(k) for k in ("population", "area"))).where("population IS NOT NULL AND area > 0")
    return _out(both, "mappingbased-literals", F.lit(d["property"]), F.round(F.col("population") / (F.col("area") / 1e6), 2).cast("string"), "literal", "", XSD + "double")
