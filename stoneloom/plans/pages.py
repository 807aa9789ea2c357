"""Page operators over the table of web pages, as they are and in the form of a wiki dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wiki
from ..operators import corpus
from ..scratch import persist_table
from ..sources import page_columns, parse_cities, read_table

_TITLE = r"(?s)<title>(.*?)</title>"
#: End of the markup of a page.
_TAIL = "&lt;ref&gt;note&lt;/ref&gt; http://x.example/y [[de:Ce]]\n== Head ==\n* item"


def wiki_blocks(spark: SparkSession, d: str) -> DataFrame:
    """``raw``: a page of a wiki dump for each web page. Some are redirects, some have no text,
    some are in another namespace, some are marked as stubs or disambiguations."""
    pages = read_table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", _TITLE, 1).alias("t"), F.regexp_replace("html", "<[^>]*>", " ").alias("visible")
    )
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("next"))
    rows = pages.join(following, "page_id", "left").withColumn("next", F.coalesce("next", F.lit("")))
    n = F.col("page_id")
    marks = F.concat(F.when(n % 3 == 0, "{{bio-stub}}").otherwise(""), F.when(n % 13 == 0, "{{Disambiguation}}").otherwise(""))
    head = F.concat(
        F.lit("'''"), "t", F.lit("''' links [["), "next", F.lit("]], [["), F.lower("t"), F.lit("|see]], [["), "next",
        F.lit("#s]], [[File:x.png]], [[#top|up]], [["), "t", F.lit("]]. "),
    )
    text = F.when(n % 7 == 3, F.concat(F.lit("#REDIRECT [["), "next", F.lit("]]"))).otherwise(F.concat(head, marks, F.lit(" "), "visible", F.lit(_TAIL)))
    body = F.when(n % 11 == 5, "").otherwise(F.concat(F.lit('<text xml:space="preserve">'), text, F.lit("</text>")))
    raw = F.concat(
        F.lit("<page>\n<title>"), "t", F.lit("</title>\n<ns>"), F.when(n % 5 == 4, "1").otherwise("0"), F.lit("</ns>\n<id>"), n.cast("string"),
        F.lit("</id>\n<revision><id>9"), n.cast("string"), F.lit("</id>"), body, F.lit("</revision>\n</page>"),
    )
    return rows.select(raw.alias("raw"))


def wiki_dump(spark: SparkSession, d: str) -> DataFrame:
    return page_columns(wiki_blocks(spark, d), "en")


def _web(spark: SparkSession, d: str) -> DataFrame:
    title = wiki.unescape(F.regexp_extract("html", _TITLE, 1))
    return read_table(spark, d, "pages").select(
        "page_id", title.alias("title"), "html", (F.char_length("html") == 0).alias("is_empty"), F.lit(False).alias("is_redirect")
    )


def title_map(spark: SparkSession, d: str) -> DataFrame:
    return corpus.title_map(_web(spark, d))


def dup_titles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_titles(title_map(spark, d))


def find_pages(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("page_id"))
    return corpus.find_pages(_web(spark, d), ids).select("page_id", "title")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"#]+)'), F.lit(1))
    return read_table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


def clean_content(spark: SparkSession, d: str) -> DataFrame:
    text = wiki.stripped(wiki.unescape(wiki.unescape(F.col("html"))))
    return read_table(spark, d, "pages").select("page_id", text.alias("text"), F.char_length(text).cast("long").alias("n"))


def separate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (text, doc_id)."""
    return read_table(spark, d, "documents").select("text", "doc_id").dropDuplicates()


def wiki_flags(spark: SparkSession, d: str) -> DataFrame:
    return wiki_dump(spark, d).drop("raw")


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return wiki_dump(spark, d).select("page_id", F.posexplode(wiki.link_destinations(F.col("raw"))).alias("pos", "link"))


def wiki_languages(spark: SparkSession, d: str) -> DataFrame:
    """Title of the page in another language."""
    return wiki_dump(spark, d).select("page_id", wiki.interlanguage_link(F.col("raw"), "de").alias("de"), wiki.interlanguage_link(F.col("raw"), "fr").alias("fr"))


def wiki_display(spark: SparkSession, d: str) -> DataFrame:
    """HTML for showing, of pages with text."""
    pages = wiki_dump(spark, d).where("NOT is_empty")
    return pages.select("page_id", wiki.display_content(F.col("title"), F.col("markup")).alias("html"))


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links as text."""
    pages = persist_table(wiki_dump(spark, d), "wiki-pages")
    found = corpus.link_graph(pages, corpus.title_map(pages))
    return found.select("id", "pr", F.array_join(F.transform("links", lambda x: x.cast("string")), " ").alias("links"))


def separate_pages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.separate_pages(wiki_dump(spark, d), distinct=True)


def find_redirects(spark: SparkSession, d: str) -> DataFrame:
    return corpus.find_redirects(wiki_dump(spark, d)).select("page_id", "title")


def city_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cities: names of several words, kinds as countries."""
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_name", "p_type")
    return parse_cities(read_table(spark, d, "part").select(line.alias("value")))


QUERIES = {
    "title_map": title_map,
    "dup_titles": dup_titles,
    "find_pages": find_pages,
    "page_links": page_links,
    "clean_content": clean_content,
    "separate_documents": separate_documents,
    "wiki_flags": wiki_flags,
    "wiki_links": wiki_links,
    "wiki_languages": wiki_languages,
    "wiki_display": wiki_display,
    "link_graph": link_graph,
    "separate_pages": separate_pages,
    "find_redirects": find_redirects,
    "city_normalise": city_normalise,
}


def _unescaped(x: str) -> str:
    for entity, character in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{character}')"
    return x


def _stripped(x: str) -> str:
    for pattern in ["<ref>.*?</ref>", "(?s)<!--.*?-->", r"http://[^ \t\n\r\f\v<]+", r"\{\{.*?\}\}", "<[^!>][^>]*>"]:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return x


def _rendered(x: str) -> str:
    for pattern, by in [
        (r"(?s)\[\[(?:File|Image|Category):[^\]]*\]\]", " "),
        (r"\[\[[^\]|]*\|([^\]]*)\]\]", r"\1"),
        (r"\[\[([^\]]*)\]\]", r"\1"),
        (r"\[https?://\S+ ([^\]]*)\]", r"\1"),
        ("''{2,5}", ""),
        (r"(?m)^\s*={1,6}\s*(.*?)\s*={1,6}\s*$", r"\1"),
        (r"(?m)^[*#:;]+\s*", ""),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_TITLES = "WITH t AS (SELECT page_id, " + _unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " AS title FROM pages WHERE html <> '') "
_DUMP = (
    r"""WITH w AS (
  SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, regexp_replace(html, '<[^>]*>', ' ', 'g') AS visible FROM pages
), x AS (
  SELECT w.*, coalesce(f.t, '') AS next FROM w LEFT JOIN w f ON f.page_id = w.page_id + 1
), y AS (
  SELECT page_id, t, CASE WHEN page_id % 7 = 3 THEN '#REDIRECT [[' || next || ']]' ELSE
    $$'''$$ || t || $$''' links [[$$ || next || ']], [[' || lower(t) || '|see]], [[' || next || '#s]], [[File:x.png]], [[#top|up]], [[' || t || ']]. '
    || CASE WHEN page_id % 3 = 0 THEN '{{bio-stub}}' ELSE '' END || CASE WHEN page_id % 13 = 0 THEN '{{Disambiguation}}' ELSE '' END
    || ' ' || visible || '&lt;ref&gt;note&lt;/ref&gt; http://x.example/y [[de:Ce]]' || chr(10) || '== Head ==' || chr(10) || '* item' END AS text
  FROM x
), z AS (
  SELECT page_id, t, CASE WHEN page_id % 11 <> 5 THEN text END AS markup,
    '<page>' || chr(10) || '<title>' || t || '</title>' || chr(10) || '<ns>' || CASE WHEN page_id % 5 = 4 THEN '1' ELSE '0' END || '</ns>' || chr(10)
    || '<id>' || page_id || '</id>' || chr(10) || '<revision><id>9' || page_id || '</id>'
    || CASE WHEN page_id % 11 = 5 THEN '' ELSE '<text xml:space="preserve">' || text || '</text>' END || '</revision>' || chr(10) || '</page>' AS raw
  FROM y
), d AS (
  SELECT page_id, """
    + _unescaped("t")
    + r""" AS title, CAST(regexp_extract(raw, '<ns>(\d+)</ns>', 1) AS INTEGER) AS ns, markup,
    regexp_extract(raw, '<ns>(\d+)</ns>', 1) = '0' AS is_article,
    coalesce(starts_with(markup, '#REDIRECT') OR starts_with(markup, '#redirect'), false) AS is_redirect,
    regexp_matches(raw, '(?i)\{\{disambig\w*\}\}') AS is_disambiguation,
    coalesce(contains(markup, 'stub}}'), false) OR contains(raw, 'Wikipedia:Stub') AS is_stub,
    NOT contains(raw, '<text xml:space="preserve">') AS is_empty, 'en' AS language, raw
  FROM z
), i AS (
  SELECT page_id, is_empty, list_transform(list_filter(list_transform(list_filter(
    regexp_extract_all(raw, '(?s)\[\[(.*?)\]\]', 1), lambda e: e <> '' AND NOT contains(e, ':')),
    lambda e: regexp_replace(e, '(?s)[|#].*', '')), lambda e: e <> ''), lambda e: trim(e)) AS l
  FROM d
), k AS (
  SELECT page_id, is_empty, unnest(l) AS link, unnest(range(len(l))) AS pos FROM i
) """
)
_SHOWN = "'<h1>' || title || '</h1>' || chr(10) || " + _rendered("markup")
_BODY = "title || chr(10) || " + _rendered(r"regexp_replace(markup, '\[\[[a-z-]+:[^\]]+\]\]', ' ', 'g')")
ORACLES = {
    "title_map": _TITLES + "SELECT lower(title) AS title, page_id FROM t",
    "dup_titles": _TITLES + "SELECT lower(title) AS title, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1",
    "find_pages": _TITLES.replace(" WHERE html <> ''", "") + "SELECT page_id, title FROM t WHERE page_id IN (SELECT item_id * 3 FROM benchmark)",
    "page_links": "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"#]+)', 1) AS l FROM pages)"
    " SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM l)",
    "clean_content": "WITH c AS (SELECT page_id, " + _stripped(_unescaped(_unescaped("html"))) + " AS text FROM pages) SELECT page_id, text, length(text) AS n FROM c",
    "separate_documents": "SELECT DISTINCT text, doc_id FROM documents",
    "wiki_flags": _DUMP + "SELECT * EXCLUDE (raw) FROM d",
    "wiki_links": _DUMP + "SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM k",
    "wiki_languages": _DUMP + r"SELECT page_id, nullif(regexp_extract(raw, '(?s)\[\[de:([^\n]*?)\]\]', 1), '') AS de,"
    r" nullif(regexp_extract(raw, '(?s)\[\[fr:([^\n]*?)\]\]', 1), '') AS fr FROM d",
    "wiki_display": _DUMP + f"SELECT page_id, regexp_replace({_SHOWN}, " + r"'\{\{.*?\}\}', ' ', 'g') AS html FROM d WHERE NOT is_empty",
    "link_graph": _DUMP
    + """, n AS (
  SELECT lower(title) AS name, max(page_id) AS dst FROM d WHERE NOT is_empty AND NOT is_redirect GROUP BY 1
), g AS (
  SELECT page_id AS id, dst, min(pos) AS pos FROM k JOIN n ON name = lower(link) WHERE NOT is_empty GROUP BY ALL
), h AS (
  SELECT id, string_agg(dst, ' ' ORDER BY pos) AS links FROM g GROUP BY id
) SELECT page_id AS id, 1.0::DOUBLE AS pr, coalesce(links, '') AS links FROM d LEFT JOIN h ON page_id = id WHERE NOT is_empty""",
    "separate_pages": _DUMP + "SELECT DISTINCT " + _stripped(_unescaped(_unescaped(_BODY))) + " AS text, page_id AS doc_id FROM d WHERE NOT is_empty",
    "find_redirects": _DUMP + "SELECT page_id, title FROM d WHERE is_redirect",
    "city_normalise": """WITH l AS (
  SELECT CAST(p_partkey AS VARCHAR) AS f0, CAST(p_size AS VARCHAR) AS f1, replace(p_name, ' ', '_') AS city, p_type AS country FROM part
) SELECT *, f0 || ' ' || f1 || ' ' || city || ' ' || country AS line FROM l""",
}
