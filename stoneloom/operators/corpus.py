"""Corpus programs over pages: title map, link graph, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wiki
from ..joins import attach
from ..scratch import persist_table

#: A side of a join may be sent to every task up to so many rows.
BROADCAST_ROWS = 1 << 18


def small_side(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a look at its first rows shows that it is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def title_map(pages: DataFrame) -> DataFrame:
    """(title, page_id) by title in lower case, of pages that are neither empty nor redirects. Titles may repeat."""
    return pages.where("NOT is_empty AND NOT is_redirect").select(F.lower("title").alias("title"), "page_id").orderBy("title", "page_id")


def duplicate_titles(titles: DataFrame) -> DataFrame:
    """(title, n) of titles with more than one page."""
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def link_graph(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, pr, links): every page that is not empty, redirects too, with rank 1 and the pages that
    its links name, each once, in the order of their first mention. Of pages with the same title the
    one with the largest id counts."""
    target = titles.groupBy(F.col("title").alias("name")).agg(F.max("page_id").alias("dst"))
    sources = pages.where("NOT is_empty")
    links = sources.select(
        F.col("page_id").alias("id"), F.posexplode(F.transform(wiki.link_destinations(F.col("raw")), F.lower)).alias("pos", "name")
    )
    # a name that very many pages link to is no join key of all of them
    sizes = links.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    named = persist_table(target.join(sizes, "name"), "link-names")
    found = attach(links, named, "name", "n", ["id", "pos"]).groupBy("id", "dst").agg(F.min("pos").alias("pos"))
    ordered = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    none = F.array().cast("array<bigint>")
    return (
        sources.select(F.col("page_id").alias("id"))
        .join(ordered, "id", "left")
        .select("id", F.lit(1.0).alias("pr"), F.coalesce(F.transform("l", lambda x: x["dst"]), none).alias("links"))
    )


def separate_pages(pages: DataFrame, distinct: bool = False) -> DataFrame:
    """(text, doc_id) of pages that are not empty."""
    out = pages.where("NOT is_empty").select(wiki.content(F.col("title"), F.col("markup")).alias("text"), F.col("page_id").alias("doc_id"))
    return out.dropDuplicates() if distinct else out


def find_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages whose id is listed, with content and flags."""
    flags = [c for c in ("is_article", "is_redirect", "is_disambiguation", "is_stub", "is_empty") if c in pages.columns]
    text = [wiki.content(F.col("title"), F.col("markup")).alias("text")] if "markup" in pages.columns else []
    return pages.join(small_side(ids.select("page_id").distinct()), "page_id", "left_semi").select("page_id", "title", *text, *flags)


def find_redirects(pages: DataFrame) -> DataFrame:
    return pages.where("is_redirect").select("page_id", "title", "raw")


def first_by_id(graph: DataFrame) -> DataFrame:
    """One row for each id."""
    order = Window.partitionBy("id").orderBy(F.size("links").desc(), "links")
    return graph.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
