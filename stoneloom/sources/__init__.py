"""Readers of the text grammars, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wiki


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of text files, compressed ones by their suffix."""
    return spark.read.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) from Parquet."""
    return spark.read.parquet(path)


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each line of each text, with all other columns."""
    return docs.withColumn("value", F.explode(F.split(text_col, "\n")))


def _pairs(text: Column) -> tuple[Column, ...]:
    """Words two by two, as two arrays; a last word alone is left out."""
    pair = F.lit(r"(\S+)\s+(\S+)")
    return tuple(F.regexp_extract_all(text, pair, F.lit(i)) for i in (1, 2))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def parse_log(lines: DataFrame) -> DataFrame:
    """(key, v) from lines of ``key int key int ...``; values that are no integers are left out."""
    keys, values = _pairs(F.col("value"))
    pairs = lines.select(F.explode(F.arrays_zip(keys.alias("key"), values.alias("v"))).alias("p"))
    return pairs.select("p.key", F.col("p.v").try_cast("int").alias("v")).where("v IS NOT NULL")


def parse_weighted_graph(lines: DataFrame, value: str = "double") -> DataFrame:
    """(id, value, adj) from ``id value (neighbour weight)*``; brackets and commas may stand around
    them. Lines of fewer than two words become id 0 without neighbours."""
    line = F.trim(F.regexp_replace("value", r"[\s\[\](){}<>,;]+", " "))
    words = F.split(line, " ")
    whole = F.size(words) >= 2
    ids, weights = _pairs(F.regexp_replace(line, r"^\S+\s*\S*\s*", ""))
    return lines.select(
        F.when(whole, F.get(words, F.lit(0)).try_cast("int")).otherwise(0).alias("id"),
        F.get(words, F.lit(1)).try_cast(value).alias("value"),
        F.arrays_zip(ids.try_cast("array<int>").alias("id"), weights.try_cast(f"array<{value}>").alias("w")).alias("adj"),
    )


def parse_link_graph(lines: DataFrame) -> DataFrame:
    """(id, pr, links) from ``id rank link*``."""
    words = _words(F.col("value"))
    return lines.select(
        F.get(words, F.lit(0)).try_cast("long").alias("id"),
        F.get(words, F.lit(1)).try_cast("double").alias("pr"),
        F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda w: w.try_cast("long")).alias("links"),
    ).where("id IS NOT NULL")


def parse_text_graph(lines: DataFrame) -> DataFrame:
    """(id, links) from ``id neighbour*`` with text ids."""
    words = _words(F.col("value"))
    return lines.where(F.size(words) > 0).select(F.get(words, F.lit(0)).alias("id"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("links"))


def parse_points(lines: DataFrame) -> DataFrame:
    """(coords, labels): words that are numbers, and the others."""
    words = _words(F.col("value"))
    return lines.select(
        F.transform(F.filter(words, lambda w: w.try_cast("double").isNotNull()), lambda w: w.try_cast("double")).alias("coords"),
        F.filter(words, lambda w: w.try_cast("double").isNull()).alias("labels"),
    )


def parse_title_map(lines: DataFrame) -> DataFrame:
    """(title, docid) from two fields with a tab between; other lines are left out."""
    fields = F.split("value", "\t")
    return lines.where(F.size(fields) == 2).select(F.get(fields, F.lit(0)).alias("title"), F.get(fields, F.lit(1)).try_cast("long").alias("docid"))


def parse_ids(lines: DataFrame) -> DataFrame:
    """(page_id): one id a line."""
    return lines.select(F.trim("value").try_cast("long").alias("page_id")).where("page_id IS NOT NULL")


def parse_cities(lines: DataFrame) -> DataFrame:
    """(f0, f1, city, country, line): names of several words joined by underscores."""
    line = lines.select(wiki.city_line(F.col("value")).alias("line"))
    words = F.split("line", r"\s+")
    return line.select(
        F.get(words, F.lit(0)).alias("f0"),
        F.try_element_at(words, F.lit(2)).alias("f1"),
        F.when(F.size(words) > 3, F.array_join(F.slice(words, 3, F.greatest(F.size(words) - 3, F.lit(0))), "_")).alias("city"),
        F.try_element_at(words, F.lit(-1)).alias("country"),
        "line",
    )


def read_xml_blocks(spark: SparkSession, path: str, start: str = "<page>", end: str = "</page>") -> DataFrame:
    """``raw``: every block from a start tag to its end tag. Records end at end tags, so blocks
    may lie across the splits of a file."""
    text = spark.read.text(path, lineSep=end)
    at = F.locate(start, F.col("value"))
    return text.where(at > 0).select(F.concat(F.col("value").substr(at, F.char_length("value")), F.lit(end)).alias("raw"))


def page_columns(blocks: DataFrame, language: str | None = "en") -> DataFrame:
    """Pages with their flags from a column ``raw``."""
    code = wiki.language_code(language)
    raw = F.col("raw")
    base = blocks.withColumn("markup", wiki.markup(raw)).withColumn("ns", wiki.namespace(raw))
    text = F.col("markup")
    return base.select(
        wiki.docid(raw).alias("page_id"),
        wiki.title(raw).alias("title"),
        "ns",
        "markup",
        wiki.is_article(F.col("ns"), code).alias("is_article"),
        wiki.is_redirect(text, code).alias("is_redirect"),
        wiki.is_disambiguation(raw, text, code).alias("is_disambiguation"),
        wiki.is_stub(raw, text).alias("is_stub"),
        wiki.is_empty(raw).alias("is_empty"),
        F.lit(language or "unk").alias("language"),
        "raw",
    )


def read_pages(spark: SparkSession, path: str, language: str | None = "en") -> DataFrame:
    """Pages of a dump, compressed or not."""
    return page_columns(read_xml_blocks(spark, path), language)


def write_key_value(df: DataFrame, path: str) -> None:
    """Text files of ``key tab value``."""
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_nothing(df: DataFrame) -> None:
    """Run for side effects only."""
    df.write.format("noop").mode("overwrite").save()


def write_graph(nodes: DataFrame, path: str) -> None:
    """Lines of ``id rank neighbour ...`` with tabs."""
    line = F.concat_ws("\t", F.col("id").cast("string"), F.col("pr").cast("string"), F.transform("links", lambda x: x.cast("string")))
    nodes.select(line.alias("value")).write.mode("overwrite").text(path)


def write_cities(cities: DataFrame, path: str, one_file: bool = False) -> None:
    """One folder for each country, or one file of lines."""
    if one_file:
        cities.select("line").coalesce(1).write.mode("overwrite").text(path)
    else:
        cities.select("line", "country").write.mode("overwrite").partitionBy("country").text(path)
