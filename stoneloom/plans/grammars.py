"""Readers and writers of the text grammars: tables are written as text into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as src
from ..operators import counting
from ..scratch import persist_lines, scratch_path
from . import graphs, pages


def _through_text(df: DataFrame, line: Column, label: str) -> DataFrame:
    return src.read_lines(df.sparkSession, persist_lines(df.select(line.alias("value")), label))


def _words(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with ids that fit the grammar's 32 bits."""
    return graphs._weighted(graphs.order_graph(spark, d))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    customers = src.read_table(spark, d, "customer")
    return _through_text(customers, _words("c_custkey", "c_name", "c_mktsegment"), "lines").select("value")


def log_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Means from lines of two keys with their values."""
    events = src.read_table(spark, d, "events")
    line = _words("event_type", F.col("value").cast("int"), F.concat(F.lit("user"), F.col("user_id").cast("string")), (F.col("event_id") % 1000))
    return counting.mean_by_key(src.parse_log(_through_text(events, line, "log")))


def weighted_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of lines ``id rank (neighbour weight)*``."""
    edges = _edges(spark, d)
    listed = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("l"))
    words = F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["dst"].cast("string"), x["w"].cast("string"))), " ")
    lines = _through_text(listed, F.concat(F.col("src").cast("string"), F.lit(" 0.5 ["), words, F.lit("]")), "weighted")
    found = src.parse_weighted_graph(lines)
    return found.select("id", "value", F.inline("adj").alias("dst", "w"))


def rank_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of lines ``id rank link*``, written by the vertex writer."""
    listed = graphs.order_graph(spark, d).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("links"))
    path = scratch_path(spark, "ranks")
    src.write_graph(listed.select("id", F.lit(0.25).alias("pr"), "links"), path)
    return src.parse_link_graph(src.read_lines(spark, path)).select("id", "pr", F.explode("links").alias("dst"))


def text_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of lines ``id neighbour*`` with text ids."""
    items = src.read_table(spark, d, "lineitem")
    listed = items.groupBy("l_returnflag", "l_linestatus").agg(F.sort_array(F.collect_set("l_linenumber")).alias("l"))
    line = F.concat_ws("  ", F.concat("l_returnflag", "l_linestatus"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("n"), x.cast("string"))), " "))
    return src.parse_text_graph(_through_text(listed, line, "text-graph")).select("id", F.explode("links").alias("dst"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates and labels of lines of numbers and names."""
    vectors = src.read_table(spark, d, "embeddings").where("embedding IS NOT NULL")
    numbers = F.array_join(F.transform("embedding", lambda x: F.floor(x * 256).cast("string")), " ")
    line = F.concat_ws(" ", F.concat(F.lit("v"), F.col("vec_id").cast("string")), numbers, F.concat(F.lit("label"), F.col("label").cast("string")))
    found = src.parse_points(_through_text(vectors, line, "points"))
    return found.select(
        F.array_join("labels", " ").alias("labels"), F.size("coords").alias("dims"), F.array_join(F.col("coords").cast("array<bigint>").cast("array<string>"), " ").alias("coords")
    )


def title_lines(spark: SparkSession, d: str) -> DataFrame:
    titles = pages.title_map(spark, d)
    return src.parse_title_map(_through_text(titles, F.concat_ws("\t", "title", F.col("page_id").cast("string")), "titles"))


def id_lines(spark: SparkSession, d: str) -> DataFrame:
    items = src.read_table(spark, d, "benchmark")
    return src.parse_ids(_through_text(items, F.concat(F.lit(" "), F.col("item_id").cast("string")), "ids"))


def compressed_dump(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a dump of several compressed files, blocks that span lines."""
    path = persist_lines(pages.wiki_blocks(spark, d), "dump", compression="bzip2")
    return src.read_pages(spark, path).select("page_id", "title", "ns", "is_redirect", F.char_length("markup").cast("long").alias("n"))


def key_values(spark: SparkSession, d: str) -> DataFrame:
    """Counts written as key and value, read as lines."""
    path = scratch_path(spark, "counts")
    src.write_key_value(src.read_table(spark, d, "lineitem").groupBy("l_suppkey").count(), path)
    return src.parse_title_map(src.read_lines(spark, path)).select(F.col("title").cast("long").alias("key"), F.col("docid").alias("n"))


def country_files(spark: SparkSession, d: str) -> DataFrame:
    """City lines written into a folder for each country, read back with their folder."""
    path = scratch_path(spark, "cities")
    src.write_cities(pages.city_normalise(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("country").cast("string").alias("country"))


QUERIES = {
    "text_lines": text_lines,
    "log_pairs": log_pairs,
    "weighted_graph": weighted_graph,
    "rank_graph": rank_graph,
    "text_graph": text_graph,
    "points": points,
    "title_lines": title_lines,
    "id_lines": id_lines,
    "compressed_dump": compressed_dump,
    "key_values": key_values,
    "country_files": country_files,
}

ORACLES = {
    "text_lines": "SELECT c_custkey || ' ' || c_name || ' ' || c_mktsegment AS value FROM customer",
    "log_pairs": "WITH p AS (SELECT event_type AS key, CAST(trunc(value) AS BIGINT) AS v FROM events UNION ALL SELECT 'user' || user_id, event_id % 1000 FROM events)"
    " SELECT key, CAST(sum(v) AS BIGINT) // count(v) AS mean FROM p WHERE v IS NOT NULL GROUP BY key",
    "weighted_graph": graphs._G + " SELECT CAST(src AS INTEGER) AS id, 0.5::DOUBLE AS value, CAST(dst AS INTEGER) AS dst, CAST((src + dst) % 7 + 1 AS DOUBLE) AS w FROM e",
    "rank_graph": graphs._G + " SELECT src AS id, 0.25::DOUBLE AS pr, dst FROM e",
    "text_graph": "SELECT DISTINCT l_returnflag || l_linestatus AS id, 'n' || l_linenumber AS dst FROM lineitem",
    "points": "SELECT 'v' || vec_id || ' label' || label AS labels, CAST(len(embedding) AS INTEGER) AS dims,"
    " array_to_string(list_transform(embedding, lambda x: CAST(floor(x * 256) AS BIGINT)), ' ') AS coords FROM embeddings WHERE embedding IS NOT NULL",
    "title_lines": pages._TITLES + "SELECT lower(title) AS title, page_id AS docid FROM t",
    "id_lines": "SELECT item_id AS page_id FROM benchmark",
    "compressed_dump": pages._DUMP + "SELECT page_id, title, ns, is_redirect, length(markup) AS n FROM d",
    "key_values": "SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1",
    "country_files": pages.ORACLES["city_normalise"].replace("SELECT *,", "SELECT country,"),
}
