"""Queries over sources: titles, ids, page texts, catalogues, grades and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_decimal, html_to_text, letter_id, mask_addresses, quotable_fragments, split_passages, title_of
from ..sources.filings import disambiguate_ids, list_documents, parse_responses, search_instruments, worst_of_group


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(F.nullif(title_of(F.col("text")), F.lit("")), F.concat(F.lit("document "), "doc_id")).alias("title"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


FILING_TITLES_SQL = r"""
SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_extract(coalesce(text, ''), '[^\x20\x09-\x0D][^\n]*'), '[\x20\x09-\x0D]+$', ''), 1, 80), ''),
       'document ' || doc_id) AS title, sha256(coalesce(text, '')) AS sha256
FROM documents
"""


def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    return disambiguate_ids(docs, "name", ["doc_id"])


DISTINCT_NAMES_SQL = """
SELECT doc_id, CASE WHEN k = 1 THEN source ELSE source || '#' || k END AS name
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


PAGE_TEXT_SQL = r"""
WITH a AS (SELECT page_id, html, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'),
      '(?i)</(?:p|div|tr|table|h[1-6]|li|section)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(regexp_replace(
      t, '(?i)&lt;', '<', 'g'), '&#39;', ''''), '(?i)&gt;', '>', 'g'), '&#160;', ' '),
      '(?i)&quot;', '"', 'g'), '(?i)&apos;', '''', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g') AS t FROM b),
d AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '[ \t\x{00A0}]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g') AS t FROM c),
e AS (SELECT page_id, html, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) AS t FROM d)
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<[a-z!/]') THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE html END AS text FROM e
"""


def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    catalog = orders.select(F.concat(F.lit("order:"), "o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"))
    return list_documents(catalog, "F", "1995-01-01", 50)


NEWEST_DOCUMENTS_SQL = """
WITH catalog AS (SELECT 'order:' || o_orderkey AS document_id, o_orderstatus AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS published_at FROM orders)
SELECT * FROM catalog WHERE (symbol = 'F' OR contains(document_id, 'F')) AND (published_at IS NULL OR published_at >= '1995-01-01')
ORDER BY published_at DESC NULLS LAST, document_id LIMIT 50
"""


def instrument_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("name"))
    return search_instruments(parts, " customer#00000001 ")


INSTRUMENT_SEARCH_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_name AS name FROM customer
WHERE CAST(c_custkey AS VARCHAR) = 'CUSTOMER#00000001' OR contains(upper(c_name), 'CUSTOMER#00000001')
ORDER BY symbol LIMIT 20
"""


def top_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    grade = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "purchase", "amber").when(F.col("event_type") == "signup", "blue").when(F.col("event_type") == "view", "unknown")
    return events.groupBy("user_id").agg(worst_of_group(grade, F.col("event_id")).alias("severity"))


TOP_SEVERITY_SQL = """
WITH graded AS (
  SELECT user_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 WHEN 'view' THEN 0 END AS grade FROM events
)
SELECT user_id, CASE max(grade) WHEN 3 THEN 'red' WHEN 2 THEN 'amber' WHEN 1 THEN 'blue' WHEN 0 THEN 'unknown' END AS severity
FROM graded GROUP BY user_id
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("output"))).alias("raw"))
    return parse_responses(turns).select("conv_id", "turn", "output", "error")


RESPONSES_SQL = r"""
SELECT conv_id, turn, text AS output, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'agent returned empty output' END AS error
FROM conversations WHERE role = 'assistant'
"""


def masked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", mask_addresses(F.concat(F.lit("see [C-A] and "), "url", F.lit(" or notes/2024-01.txt for 12"))).alias("masked"))


MASKED_URLS_SQL = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace('see [C-A] and ' || url || ' or notes/2024-01.txt for 12',
  '\[[A-Z]-[A-Z]+\]', ' ', 'g'), 'https?://[^\x20\x09-\x0D]+', ' ', 'g'), '(?i)[a-z0-9_./\\-]*\.(?:txt|pdf|md|csv|json|xml|html?|docx?)\b', ' ', 'g') AS masked
FROM pages
"""


def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", letter_id(F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1, "C").alias("claim_id"))


#: Bijective numerals of base 26, a letter for each step, as many as a long may need.
CLAIM_IDS_SQL = """
WITH RECURSIVE n AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS BIGINT) * 7 + l_linenumber - 1 AS rest, '' AS letters FROM lineitem),
r AS (
  SELECT * FROM n
  UNION ALL SELECT l_orderkey, l_linenumber, rest // 26 - 1, chr(CAST(65 + rest % 26 AS INTEGER)) || letters FROM r WHERE rest >= 0
)
SELECT l_orderkey, l_linenumber, 'C-' || letters AS claim_id FROM r WHERE rest < 0
"""


def canonical_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_number("o_totalprice", 4)
    return _table(spark, sf_dir, "orders").select("o_orderkey", canonical_decimal(F.concat(F.lit("-0"), price)).alias("value"), canonical_decimal(F.concat(price, F.lit("x"))).alias("refused"))


CANONICAL_PRICES_SQL = r"""
SELECT o_orderkey, '-' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS VARCHAR), '0+$', ''), '\.$', '') AS value, CAST(NULL AS VARCHAR) AS refused
FROM orders
"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_passages(F.col("text"))).alias("passage_no", "passage"))
    pieces = passages.select("doc_id", "passage_no", F.posexplode(quotable_fragments(F.col("passage"))).alias("fragment_no", "fragment"))
    return pieces.groupBy("doc_id", "passage_no").agg(
        F.count("*").alias("n_fragments"), F.sum(F.length("fragment")).cast("long").alias("n_chars"), F.max(F.when(F.col("fragment").contains(","), F.length("fragment"))).cast("long").alias("longest_with_comma")
    )


QUERIES = {
    "filing_titles": filing_titles,
    "distinct_names": distinct_names,
    "page_text": page_text,
    "newest_documents": newest_documents,
    "instrument_search": instrument_search,
    "top_severity": top_severity,
    "responses": responses,
    "masked_urls": masked_urls,
    "claim_ids": claim_ids,
    "canonical_prices": canonical_prices,
    "fragments": fragments,
}
ORACLES = {
    "filing_titles": FILING_TITLES_SQL,
    "distinct_names": DISTINCT_NAMES_SQL,
    "page_text": PAGE_TEXT_SQL,
    "newest_documents": NEWEST_DOCUMENTS_SQL,
    "instrument_search": INSTRUMENT_SEARCH_SQL,
    "top_severity": TOP_SEVERITY_SQL,
    "responses": RESPONSES_SQL,
    "masked_urls": MASKED_URLS_SQL,
    "claim_ids": CLAIM_IDS_SQL,
    "canonical_prices": CANONICAL_PRICES_SQL,
}
