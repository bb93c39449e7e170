"""Record files, side tables, reports, and a replayable paged source."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrel.functions.terms import RDF, XSD, fold_name

ARTICLE = "id bigint, title string, text string, revision_id bigint, revision_timestamp string"


def read_articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines (also gzipped) of articles; torn lines are dropped. limit: the least ids."""
    df = spark.read.schema(ARTICLE + ", _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    df = df.where("_torn IS NULL AND id IS NOT NULL").drop("_torn")
    return df.orderBy("id").limit(limit) if limit else df


def read_pairs(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two-column tab-separated files without quoting."""
    return spark.read.schema(f"{key} string, {value} string").option("sep", "\t").option("quote", "").csv(path)


def last_wins(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value))


def read_roots(spark: SparkSession, path: str, depth: int = 1, prefix: str = "") -> DataFrame:
    """(node, depth) of lines 'name | depth' with # comments; a namespace prefix is stripped."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    df = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    name = F.trim(F.split_part("line", F.lit("|"), F.lit(1)))
    if prefix:
        name = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    return df.select(name.alias("node"), F.coalesce(F.split_part("line", F.lit("|"), F.lit(2)).try_cast("int"), F.lit(depth)).alias("depth"))


def checked_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots with n, the members of each, 0 for missing or empty ones."""
    n = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    return roots.join(n, "node", "left").na.fill(0, ["n"])


def suggested_roots(roots: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(node, suggestions) of the roots (node) that are missing or empty: up to limit categories whose folded name holds the root's
    longest word, the shorter names first."""
    missing = checked_roots(roots, edges).where("n = 0").select("node").distinct()
    word = F.element_at(F.array_sort(F.filter(F.split(fold_name(F.col("node")), " "), lambda w: w != ""), lambda a, b: F.when(F.length(a) > F.length(b), 1).when(F.length(a) < F.length(b), -1).otherwise(0)), -1)
    known = edges.select(F.col("parent").alias("name")).distinct().select("name", F.explode(F.array_distinct(F.split(fold_name(F.col("name")), " "))).alias("word"))
    hits = missing.withColumn("word", word).join(known, "word").select("node", "name")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.length("name"), "name"))
    best = hits.withColumn("place", place).where(F.col("place") <= limit).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("suggestions"))
    return missing.join(best, "node", "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def categories_of(edges: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(child, categories): the categories (parents) of every page in order of their names, without those of hidden (node)."""
    kept = edges if hidden is None else edges.join(hidden.select(F.col("node").alias("parent")), "parent", "left_anti")
    return kept.select("child", "parent").distinct().groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("categories"))


def members(edges: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """(pages, subcategories) of a category from (parent, child, ns)."""
    own = edges.where(F.col("parent") == category)
    return own.where("ns <> 14"), own.where("ns = 14")


def compacted(records: DataFrame, order: str) -> DataFrame:
    """Equal records once, the first by order; order itself does not count."""
    keys = [c for c in records.columns if c != order]
    return records.groupBy(*keys).agg(F.min(order).alias(order))


def not_done(ids: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(done.select(key).distinct(), key, "left_anti")


def merged_pages(parts: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key from continued responses: of each column the last non-null value by order."""
    cols = [c for c in parts.columns if c not in (key, order)]
    return parts.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols))


def first_existing(folder: str, stems: list[str]) -> Path | None:
    """The first file there of several in order of precedence."""
    return next((p for s in stems if (p := Path(folder, s)).exists()), None)


def planned_files(folder: str, wanted: dict[str, list[str]]) -> dict[str, Path]:
    """For each name the first file there of several in order of precedence; names without one are left out."""
    found = {name: first_existing(folder, stems) for name, stems in wanted.items()}
    return {name: path for name, path in found.items() if path}


def write_summary(summary: dict, path: str) -> None:
    """A small JSON report, in the order of its keys, replaced as a whole."""
    target = Path(path)
    part = target.with_suffix(".part")
    part.write_text(json.dumps(summary, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    part.replace(target)


def cached(path: str, make) -> dict:
    """The JSON at path, made and written first where it is absent."""
    if not Path(path).exists():
        write_summary(make(), path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 15) -> str:
    """A table of the first rows and how many more there are."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n… {df.count() - most} more")
    return "\n".join(lines)


def void(triples: DataFrame, dataset: str, base: str) -> DataFrame:
    """The VoID description: triples, distinct subjects and, per subset (column dataset), its triples."""
    total = triples.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("entities"))
    whole = total.select(F.lit(base + dataset).alias("s"), F.explode(F.create_map(F.lit("triples"), "triples", F.lit("entities"), "entities")).alias("k", "n"))
    parts = triples.groupBy("dataset").agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{base}{dataset}/"), "dataset").alias("s"), F.lit("triples").alias("k"), "n")
    num = lambda df: df.select("s", F.concat(F.lit("http://rdfs.org/ns/void#"), "k").alias("p"), F.col("n").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("").alias("o_lang"), F.lit(XSD + "integer").alias("o_dt"))
    link = parts.select(F.lit(base + dataset).alias("s"), F.lit("http://rdfs.org/ns/void#subset").alias("p"), F.col("s").alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_lang"), F.lit("").alias("o_dt"))
    kind = whole.select("s", F.lit(RDF + "type").alias("p"), F.lit("http://rdfs.org/ns/void#Dataset").alias("o"), F.lit("uri").alias("o_kind"), F.lit("").alias("o_lang"), F.lit("").alias("o_dt")).distinct()
    return reduce(DataFrame.unionByName, [num(whole), num(parts), link, kind])


class PagedJson(DataSource):
    """Recorded API responses, one folder per request: pages 0.json, 1.json, ... are followed while they say 'continue'.

    options: path, a shared folder. Rows: request, page, body."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "request string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"])


class _PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.path).iterdir()) if p.is_dir()] or [InputPartition("")]

    def read(self, partition):
        folder, page = Path(partition.value), 0
        while partition.value and (f := folder / f"{page}.json").exists():
            body = f.read_text(encoding="utf-8")
            yield folder.name, page, body
            if "continue" not in json.loads(body):
                return
            page += 1
