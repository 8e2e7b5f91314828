"""Readers of documents, maps, lines, tables, XML and rule files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "corpus array<struct<id:string,date:string,original:string,translation:string,reference:string>>"


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``{corpus: [...]}`` documents as rows with their position, which is part of the meaning."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    return raw.select(F.posexplode("corpus").alias("pos", "row")).select("pos", "row.*")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object file as (key, value) rows; ``value`` is the values' type."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def json_lines(spark: SparkSession, path: str, schema: str, required: str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are dropped, or an error if ``strict``; rows without ``required`` are dropped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.filter(F.col(required).isNotNull()) if required else rows


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key in file order (file, then position)."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return rows.withColumn("_at", at).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_at").alias("r")).select(key, "r.*")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of an XML file, whatever root they stand in; broken elements are dropped."""
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("mode", "DROPMALFORMED").load(path)


def files_in_order(rows: DataFrame) -> DataFrame:
    """``rows`` read from files, with ``file_no``, the place of each one's file among the sorted paths: a rank over a row a file."""
    named = rows.withColumn("_file", F.col("_metadata.file_path"))
    files = named.select("_file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("_file")).cast("long") - 1)
    return named.join(files, "_file").drop("_file")


def xml_fallback(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Contents of a tag by pattern, for files that don't parse."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select("file", F.explode(F.regexp_extract_all("value", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))).alias(tag))


def html_spans(pages: DataFrame, key: str, html: str, css_class: str) -> DataFrame:
    """Texts of spans of a class, in order, repeats kept."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf'(?s)<span[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</span>'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "span"))


def rule_table(path: str, columns: int = 2) -> list[tuple[str, ...]]:
    """Tab-separated rules in file order; ``#`` comments and blank lines skipped; an empty file is an error, as is a short line."""
    with open(path, encoding="utf-8") as f:
        lines = [x.rstrip("\n") for x in f if x.strip() and not x.startswith("#")]
    rules = [tuple(x.split("\t"))[:columns] for x in lines]
    if not rules:
        raise ValueError(f"no rules in {os.path.basename(path)}")
    if any(len(r) < columns for r in rules):
        raise ValueError(f"a line of {os.path.basename(path)} has fewer than {columns} columns")
    return rules


def rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """(place, fields) of tab-separated rules in file order, read by Spark from wherever it reads; ``#`` comments and blank lines skipped.

    The file is one row, as its order matters and rules are few.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
    return lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#")).select("place", F.split("line", "\t").alias("fields"))


def log_pairs(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Counts of the two groups of ``pattern`` over log files."""
    raw = spark.read.text(path)
    zipped = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("b"))
    return raw.select(F.inline(zipped)).toDF("a", "b").groupBy("a", "b").count()


def slice_rows(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in order; a start past the end is an error."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more and limit 1 or more")
    out = df.orderBy(*order).offset(offset).limit(limit)
    if offset and not out.take(1):
        raise ValueError(f"offset {offset} is past the end")
    return out


def choose(kind: str, known: dict):
    """A source or recogniser by its configured name; an unknown name is an error at the start."""
    if kind not in known:
        raise ValueError(f"unknown mode {kind!r}; known: {', '.join(sorted(known))}")
    return known[kind]


def person_master(career: DataFrame) -> DataFrame:
    """Career rows (person, year, names..., office) -> a row a person: first value of each column, filled years, offices in order without repeats."""
    order = F.struct(F.coalesce("year", F.lit(2147483647)).alias("year"), "pos")
    rest = [c for c in career.columns if c not in ("person_id", "year", "pos", "office", "born", "died")]
    offices = F.array_sort(F.collect_list(F.when(F.col("office").isNotNull(), F.struct(order.alias("k"), "office"))))
    return career.groupBy("person_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in rest],
        F.coalesce(F.min("year"), F.min("born")).alias("active_from"),
        F.coalesce(F.max("year"), F.max("died")).alias("active_to"),
        F.array_distinct(F.transform(offices, lambda x: x["office"])).alias("offices"),
    )


def inverted_index(people: DataFrame, names: list[str]) -> DataFrame:
    """(surface, pos, person_id): every name whole and without its first character, in input order, repeats kept."""
    parts = F.concat(*[F.array(F.col(n), F.when(F.length(n) > 1, F.substr(F.col(n), F.lit(2)))) for n in names])
    rows = people.select("person_id", "pos", F.posexplode(parts).alias("k", "surface")).filter("surface is not null and surface <> ''")
    return rows.select("surface", F.row_number().over(Window.partitionBy("surface").orderBy("pos", "k")).alias("pos"), "person_id")
