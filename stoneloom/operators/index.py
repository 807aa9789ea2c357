"""Inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import exploded, is_stopword

#: Documents of one block of postings. A term that stands in most documents has a list for each
#: block, so no row and no task has to hold all its postings.
BLOCK_DOCS = 1 << 20

#: Bytes of text whose tokens one task counts, about: the tasks grow in number with the input, not in memory.
PART_BYTES = 8 << 20


def _tasks(docs: DataFrame, text_bytes: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PART_BYTES))


def whole_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` dealt by id before their texts become tokens, so that the texts pass an exchange and not a row
    for each word of each document. If one id has several rows with more text than a task should get, rows stay where they are."""
    ids = docs.groupBy(id_col).agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total, shared = ids.agg(F.sum("bytes"), F.max(F.when(F.col("rows") > 1, F.col("bytes")))).first()
    return docs if (shared or 0) > PART_BYTES else docs.select(id_col, text_col).repartition(_tasks(docs, total or 0), id_col)


def term_frequencies(docs: DataFrame, mode: str = "alnum", stopwords: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf). ``stopwords``: leave them out."""
    return _counted(whole_documents(docs, id_col, text_col), mode, stopwords, id_col, text_col)


def _counted(docs: DataFrame, mode: str, stopwords: bool, id_col: str, text_col: str) -> DataFrame:
    terms = exploded(docs, text_col, mode, F.col(id_col).alias("doc_id"))
    if stopwords:
        terms = terms.where(~is_stopword(F.col("term")))
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def line_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf) by single blanks, line by line, every word counted."""
    lines = whole_documents(docs, id_col, text_col).select(id_col, F.explode(F.split(text_col, "\n")).alias("value"))
    return _counted(lines, "single_ws", False, id_col, "value")


def inverted_index(tf: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, df, postings): postings (doc_id, tf) by ascending id, in blocks of ids."""
    block = F.floor(F.col("doc_id") / block_docs)
    return (
        tf.groupBy("term", block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
        .select("term", "block", F.size("postings").cast("long").alias("df"), "postings")
    )


def index_documents(
    docs: DataFrame, mode: str = "alnum", stopwords: bool = True, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``inverted_index`` of documents with one exchange: tokens are dealt by term and block once, and
    both the frequencies and the postings are made from these parts, as many as the texts' size asks for."""
    block = F.floor(F.col(id_col) / block_docs)
    terms = exploded(docs, text_col, mode, F.col(id_col).alias("doc_id"), block.alias("block"))
    if stopwords:
        terms = terms.where(~is_stopword(F.col("term")))
    tasks = _tasks(docs, docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    tf = terms.repartition(tasks, "term", "block").groupBy("term", "block", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    found = tf.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    return found.select("term", "block", F.size("postings").cast("long").alias("df"), "postings")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lookup(index: DataFrame, term: str) -> DataFrame:
    """Postings of a term: (doc_id, tf)."""
    return index.where(F.col("term") == term).select(F.inline("postings"))
