"""Term counts, means, co-occurrence and inverted index over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import STOPWORDS
from ..operators import cooccurrence, counting, index
from ..sources import lines_of, read_table


def _counts(mode: str):
    return lambda spark, d: counting.term_counts(read_table(spark, d, "documents"), mode, "text")


def wc_single_ws(spark: SparkSession, d: str) -> DataFrame:
    return counting.term_counts(lines_of(read_table(spark, d, "conversations")), "single_ws")


def wc_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return counting.term_counts(read_table(spark, d, "documents"), "alnum", "text", partitions=5)


def log_mean(spark: SparkSession, d: str) -> DataFrame:
    return counting.mean_by_key(read_table(spark, d, "events"), "event_type", F.col("value").cast("long"))


def log_mean_by_user(spark: SparkSession, d: str) -> DataFrame:
    return counting.mean_by_key(read_table(spark, d, "events"), "user_id", F.col("value").cast("long"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(read_table(spark, d, "documents")).select("value")


def cooc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.pairs(_lines(spark, d))


def cooc_absolute(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.with_marginals(cooc_pairs(spark, d), cooc_marginals(spark, d))


def cooc_marginals(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.totals(_lines(spark, d))


def cooc_relative(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.relative(cooc_pairs(spark, d), cooc_marginals(spark, d)).withColumn("f", F.round("f", 6))


def cooc_marker_first(spark: SparkSession, d: str) -> DataFrame:
    """Totals and counts with their place within the word."""
    order = Window.partitionBy("w").orderBy(F.desc("is_marginal"), "u")
    return cooccurrence.marker_first(cooc_pairs(spark, d), cooc_marginals(spark, d)).withColumn("place", F.row_number().over(order))


def cooc_window2(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.pairs(_lines(spark, d), window=2)


def cooc_stripes(spark: SparkSession, d: str) -> DataFrame:
    """Stripes, one row for each entry, and one for each empty stripe."""
    found = cooccurrence.stripes(_lines(spark, d))
    return found.select("w", F.explode_outer("stripe").alias("u", "n"))


def inv_index_basic(spark: SparkSession, d: str) -> DataFrame:
    return index.line_frequencies(read_table(spark, d, "documents"))


def inv_index(spark: SparkSession, d: str) -> DataFrame:
    return index.term_frequencies(read_table(spark, d, "documents"))


def index_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequencies(inv_index(spark, d))


def index_postings_text(spark: SparkSession, d: str) -> DataFrame:
    found = index.index_documents(read_table(spark, d, "documents"))
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ")
    return found.select("term", "block", "df", text.alias("postings"))


def stopword_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = counting.term_counts(read_table(spark, d, "documents"), "alnum", "text")
    return counts.where(F.col("term").isin(sorted(STOPWORDS)))


QUERIES = {
    "wc_strip_last": _counts("strip_last"),
    "wc_raw": _counts("raw"),
    "wc_alnum": _counts("alnum"),
    "wc_single_ws": wc_single_ws,
    "wc_partitioned": wc_partitioned,
    "log_mean": log_mean,
    "log_mean_by_user": log_mean_by_user,
    "cooc_pairs": cooc_pairs,
    "cooc_absolute": cooc_absolute,
    "cooc_marginals": cooc_marginals,
    "cooc_relative": cooc_relative,
    "cooc_marker_first": cooc_marker_first,
    "cooc_window2": cooc_window2,
    "cooc_stripes": cooc_stripes,
    "inv_index_basic": inv_index_basic,
    "inv_index": inv_index,
    "index_doc_freq": index_doc_freq,
    "index_postings_text": index_postings_text,
    "stopword_counts": stopword_counts,
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOPWORDS))
_WORDS = r"SELECT {key}lower(w) AS t FROM (SELECT {key}unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS w FROM documents) WHERE w <> ''"
_ALNUM = (
    "SELECT doc_id, t FROM (SELECT doc_id, regexp_replace(lower(unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'))),"
    " '[^A-Za-z0-9]', '', 'g') AS t FROM documents) WHERE t <> ''"
)


def _single(source: str, key: str = "") -> str:
    """(key, line number, words) of lines split at single blanks."""
    return (
        f"SELECT {key}CASE WHEN line = '' THEN [''] WHEN regexp_replace(line, '[ \\t\\n\\r\\f\\v]+$', '') = '' THEN []"
        " ELSE regexp_split_to_array(regexp_replace(line, '[ \\t\\n\\r\\f\\v]+$', ''), '[ \\t\\n\\r\\f\\v]') END AS ws"
        f" FROM (SELECT {key}unnest(string_split(text, chr(10))) AS line FROM {source})"
    )


def _pairs(window: int, w: str = "lower({})") -> str:
    """CTEs ``words`` (line, place, word) of ``lines`` and ``p`` (w, u)."""
    sides = " UNION ALL ".join(
        f"SELECT {w.format(f'{x}.t')} AS w, lower({y}.t) AS u FROM words a JOIN words b ON a.line = b.line AND b.i = a.i + {n}"
        for n in range(1, window + 1)
        for x, y in ("ab", "ba")
    )
    return f"words AS (SELECT line, unnest(ws) AS t, unnest(range(len(ws))) AS i FROM (SELECT row_number() OVER () AS line, ws FROM lines)), p AS ({sides})"


_LINES = f"WITH lines AS ({_single('documents')}), "
_COOC = f"{_LINES}{_pairs(1)}, c AS (SELECT w, u, count(*) AS n FROM p GROUP BY w, u) "
_TF = f"WITH a AS ({_ALNUM}), tf AS (SELECT t AS term, doc_id, count(*) AS tf FROM a WHERE t NOT IN ({_STOP}) GROUP BY t, doc_id) "

ORACLES = {
    "wc_strip_last": f"WITH t AS ({_WORDS.format(key='')}) SELECT CASE WHEN regexp_matches(t, '[^a-zA-Z0-9 ]') THEN substr(t, 1, length(t) - 1) ELSE t END AS term, count(*) AS n FROM t GROUP BY 1",
    "wc_raw": f"WITH t AS ({_WORDS.format(key='')}) SELECT t AS term, count(*) AS n FROM t GROUP BY 1",
    "wc_alnum": f"WITH t AS ({_ALNUM}) SELECT t AS term, count(*) AS n FROM t GROUP BY 1",
    "wc_partitioned": f"WITH t AS ({_ALNUM}) SELECT t AS term, count(*) AS n FROM t GROUP BY 1",
    "wc_single_ws": f"WITH lines AS ({_single('conversations')}), t AS (SELECT lower(unnest(ws)) AS t FROM lines) SELECT t AS term, count(*) AS n FROM t GROUP BY 1",
    "log_mean": "SELECT event_type AS key, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) // count(value) AS mean FROM events GROUP BY 1",
    "log_mean_by_user": "SELECT user_id AS key, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) // count(value) AS mean FROM events GROUP BY 1",
    "cooc_pairs": _COOC + "SELECT w, u, n FROM c",
    "cooc_absolute": _COOC
    + "SELECT w, u, n, false AS is_marginal FROM c UNION ALL SELECT w, NULL, CAST(sum(n) AS BIGINT), true FROM c GROUP BY w",
    "cooc_marginals": _COOC + "SELECT w, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY w",
    "cooc_relative": _COOC + "SELECT w, u, n, round(n / sum(n) OVER (PARTITION BY w), 6) AS f FROM c",
    "cooc_marker_first": _COOC
    + ", t AS (SELECT w, u, n, false AS is_marginal FROM c UNION ALL SELECT w, NULL, CAST(sum(n) AS BIGINT), true FROM c GROUP BY w)"
    + " SELECT *, CAST(row_number() OVER (PARTITION BY w ORDER BY is_marginal DESC, u) AS INTEGER) AS place FROM t",
    "cooc_window2": f"{_LINES}{_pairs(2)} SELECT w, u, count(*) AS n FROM p GROUP BY w, u",
    "cooc_stripes": f"{_LINES}{_pairs(1, '{}')} SELECT w, u, count(*) AS n FROM p GROUP BY w, u"
    " UNION ALL SELECT DISTINCT ws[1], NULL, CAST(NULL AS BIGINT) FROM lines WHERE len(ws) = 1 AND ws[1] NOT IN (SELECT w FROM p)",
    "inv_index_basic": f"WITH lines AS ({_single('documents', 'doc_id, ')}), t AS (SELECT doc_id, lower(unnest(ws)) AS term FROM lines) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2",
    "inv_index": _TF + "SELECT term, doc_id, tf FROM tf",
    "index_doc_freq": _TF + "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "index_postings_text": _TF
    + f"SELECT term, doc_id // {index.BLOCK_DOCS} AS block, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM tf GROUP BY 1, 2",
    "stopword_counts": f"WITH t AS ({_ALNUM}) SELECT t AS term, count(*) AS n FROM t WHERE t IN ({_STOP}) GROUP BY 1",
}
