"""Programs by name: ``python -m stoneloom PROGRAM ARGUMENT...``

wordcount MODE IN OUT [PARTITIONS]        cooccurrence pairs|stripes|relative|absolute IN OUT
logmean IN OUT                            index IN OUT [PARTITIONS]      (documents as Parquet)
pagerank-step IN OUT                      pagerank IN OUT NODES ITERATIONS
pagerank-vertex IN OUT ITERATIONS         pagerank-simple IN OUT [ITERATIONS]
bfs IN OUT [STEPS]                        kmeans IN OUT K ITERATIONS
titles IN OUT [LANGUAGE]                  links IN OUT TITLES [LANGUAGE]
separate IN OUT [LANGUAGE]                find IN OUT IDS [LANGUAGE]
redirects IN OUT [LANGUAGE]               linkcount IN OUT [PARTITIONS]
cities IN OUT [oneFile]                   dump IN OUT LANGUAGE
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as src
from .operators import cluster, cooccurrence, corpus, counting, graph, index
from .operators.metrics import counted
from .scratch import release_scratch
from .session import session


def wordcount(spark: SparkSession, mode: str, path: str, out: str, partitions: str = "") -> None:
    n = int(partitions) if partitions else None
    src.write_key_value(counting.term_counts(src.read_lines(spark, path), mode, partitions=n), out)


def logmean(spark: SparkSession, path: str, out: str) -> None:
    src.write_key_value(counting.mean_by_key(src.parse_log(src.read_lines(spark, path))), out)


def cooccur(spark: SparkSession, form: str, path: str, out: str) -> None:
    lines = src.read_lines(spark, path)
    if form == "stripes":
        src.write_table(cooccurrence.stripes(lines), out)
        return
    counted = cooccurrence.pairs(lines)
    forms = {"pairs": lambda: counted, "relative": lambda: cooccurrence.relative(counted), "absolute": lambda: cooccurrence.with_marginals(counted)}
    src.write_key_value(forms[form](), out)


def inverted(spark: SparkSession, path: str, out: str, partitions: str = "37") -> None:
    found = index.index_documents(src.read_documents(spark, path))
    src.write_table(found.repartition(int(partitions), "term").sortWithinPartitions("term", "block"), out)


def _graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = src.parse_link_graph(src.read_lines(spark, path))
    return nodes, graph.edges_of(nodes)


def _write_ranks(nodes: DataFrame, ranks: DataFrame, out: str) -> None:
    none = F.array().cast("array<bigint>")
    joined = ranks.join(nodes.select("id", "links"), "id", "left").withColumn("links", F.coalesce("links", none))
    src.write_graph(joined, out)


def pagerank_step(spark: SparkSession, path: str, out: str) -> None:
    nodes = src.parse_weighted_graph(src.read_lines(spark, path)).withColumn("links", F.col("adj.id"))
    ranks = nodes.select("id", F.col("value").alias("pr"))
    src.write_key_value(graph.pagerank_step(ranks, graph.edges_of(nodes)), out)


def pagerank(spark: SparkSession, path: str, out: str, n: str, iterations: str) -> None:
    nodes, edges = _graph(spark, path)
    _write_ranks(nodes, graph.pagerank_two_phase(nodes.select("id", "pr"), edges, int(n), int(iterations)).df, out)


def pagerank_vertex(spark: SparkSession, path: str, out: str, iterations: str) -> None:
    nodes, edges = _graph(spark, path)
    _write_ranks(nodes, graph.pagerank_vertex(nodes.select("id", "pr"), edges, int(iterations) + 1).df, out)


def pagerank_simple(spark: SparkSession, path: str, out: str, iterations: str = "1000") -> None:
    nodes = src.parse_text_graph(src.read_lines(spark, path))
    src.write_key_value(graph.pagerank_simple(nodes, graph.edges_of(nodes), int(iterations)).df, out)


def bfs(spark: SparkSession, path: str, out: str, steps: str = "1") -> None:
    nodes = src.parse_weighted_graph(src.read_lines(spark, path), "int")
    edges = nodes.select(F.col("id").alias("src"), F.inline("adj")).select("src", F.col("id").alias("dst"), "w")
    src.write_key_value(graph.sssp(nodes.select("id", F.col("value").alias("dist")), edges, int(steps)).df, out)


def kmeans(spark: SparkSession, path: str, out: str, k: str, iterations: str) -> None:
    points = src.parse_points(src.read_lines(spark, path)).withColumn("point_id", F.xxhash64("coords", "labels"))
    found = cluster.kmeans(points, int(k), int(iterations))
    src.write_table(found.assignment, f"{out}/points")
    rows = [(i, found.sizes[i], len(c), c) for i, c in sorted(found.centroids.items())]
    src.write_table(spark.createDataFrame(rows, "idx int, size long, dims int, centroid array<double>"), f"{out}/clusters")


def titles(spark: SparkSession, path: str, out: str, language: str = "en") -> None:
    src.write_key_value(corpus.title_map(src.read_pages(spark, path, language)), out)


def links(spark: SparkSession, path: str, out: str, mapping: str, language: str = "en") -> None:
    names = src.parse_title_map(src.read_lines(spark, mapping)).withColumnRenamed("docid", "page_id")
    src.write_graph(corpus.link_graph(src.read_pages(spark, path, language), names), out)


def separate(spark: SparkSession, path: str, out: str, language: str = "en") -> None:
    src.write_table(corpus.separate_pages(src.read_pages(spark, path, language)), out)


def find(spark: SparkSession, path: str, out: str, ids: str, language: str = "en") -> None:
    src.write_table(corpus.find_pages(src.read_pages(spark, path, language), src.parse_ids(src.read_lines(spark, ids))), out)


def redirects(spark: SparkSession, path: str, out: str, language: str = "en") -> None:
    src.write_table(corpus.find_redirects(src.read_pages(spark, path, language)), out)


def linkcount(spark: SparkSession, path: str, out: str, partitions: str = "10") -> None:
    src.write_key_value(graph.line_in_links(src.read_lines(spark, path)).repartition(int(partitions), "id"), out)


def cities(spark: SparkSession, path: str, out: str, one_file: str = "") -> None:
    src.write_cities(src.parse_cities(src.read_lines(spark, path)), out, one_file == "oneFile")


def dump(spark: SparkSession, path: str, out: str, language: str) -> None:
    kinds = {k: F.col(f"is_{k}") for k in ("article", "redirect", "disambiguation", "stub", "empty")}
    pages, seen = counted(src.read_pages(spark, path, language), "pages", **kinds)
    src.write_table(pages, out)
    print(" ".join(f"{k}={n}" for k, n in seen.get.items()), file=sys.stderr)


PROGRAMS = {
    "wordcount": wordcount,
    "logmean": logmean,
    "cooccurrence": cooccur,
    "index": inverted,
    "pagerank-step": pagerank_step,
    "pagerank": pagerank,
    "pagerank-vertex": pagerank_vertex,
    "pagerank-simple": pagerank_simple,
    "bfs": bfs,
    "kmeans": kmeans,
    "titles": titles,
    "links": links,
    "separate": separate,
    "find": find,
    "redirects": redirects,
    "linkcount": linkcount,
    "cities": cities,
    "dump": dump,
}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in PROGRAMS:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or session(args[0])
    try:
        PROGRAMS[args[0]](spark, *args[1:])
        release_scratch(spark)  # the results are written
    except TypeError as e:
        if "positional argument" not in str(e):
            raise
        print(f"{args[0]}: {e}\n{__doc__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
