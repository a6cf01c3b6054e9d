"""Queries over feeds, plans, gaps, counter-evidence and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from ..sources import feeds


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of a page of a feed: pages are bounded however many rows a customer or user has.
PAGE_KEYS = 1000


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as a feed of parallel arrays, in pages."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("cik"),
        F.floor(F.col("o_orderkey") / PAGE_KEYS).alias("page"),
        F.struct(
            "o_orderkey",
            F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("00-"), "o_orderkey")).alias("a"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
            F.col("o_orderstatus").alias("f"),
            F.concat("o_orderpriority", F.lit(".htm")).alias("p"),
        ).alias("x"),
    )
    feed = orders.groupBy("cik", "page").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def field(name: str):
        return F.transform("xs", lambda x: x[name])

    recent = F.struct(field("a").alias("accessionNumber"), field("d").alias("filingDate"), field("f").alias("form"), field("p").alias("primaryDocument"))
    return feeds.explode_submissions(feed.select("cik", "page", F.concat(F.lit("customer "), "cik").alias("name"), recent.alias("recent")), "1995-01-01", 5, "page")


SUBMISSIONS_SQL = """
WITH r AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published_at, o_orderstatus AS form, o_orderpriority || '.htm' AS p,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k
  FROM orders WHERE o_orderkey % 7 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'
)
SELECT 'edgar:' || cik || ':00' || o_orderkey || ':' || p AS document_id, 'customer ' || cik || ' ' || form || ' ' || published_at AS title, published_at, cik, k FROM r WHERE k <= 5
"""


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _table(spark, sf_dir, "orders").select(F.lower(F.concat(F.lit(" customer#"), F.lpad((F.col("o_custkey") + 700).cast("string"), 9, "0"))).alias("symbol")).distinct()
    return feeds.resolve_tickers(symbols, _table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik_str")))


TICKERS_SQL = """
SELECT DISTINCT ' customer#' || lpad(CAST(o_custkey + 700 AS VARCHAR), 9, '0') AS symbol, c_custkey AS cik, CASE WHEN c_custkey IS NULL THEN 'not_found' END AS failure
FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey + 700 AS VARCHAR), 9, '0')
"""


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as pages of a JSON array, or for odd users of an envelope."""
    events = _table(spark, sf_dir, "events")
    item = F.struct(F.when(F.col("event_id") % 5 > 0, F.col("event_id").cast("string")).alias("id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("published_at"))
    by_user = events.groupBy("user_id", F.floor(F.col("event_id") / PAGE_KEYS).alias("page")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))).alias("xs")).select("user_id", F.transform("xs", lambda x: x["item"]).alias("items"))
    body = F.when(F.col("user_id") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items")))
    return feeds.parse_announcements(by_user.select("user_id", body.alias("body"))).select("user_id", "announcement_id", "published", "kind", "error")


ANNOUNCEMENTS_SQL = """
SELECT user_id, CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS VARCHAR) END AS announcement_id, strftime(ts, '%Y-%m-%d') AS published, event_type AS kind,
       CASE WHEN event_id % 5 = 0 THEN 'announcement without an id' END AS error
FROM events
"""


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages of one document."""
    turns = _table(spark, sf_dir, "conversations")
    chunk = F.array(F.struct(F.lit(1).alias("seq"), F.lit("!").alias("content")), F.struct(F.lit(None).cast("int").alias("seq"), F.col("text").alias("content")))
    pages = turns.select(
        F.col("conv_id").alias("document_id"),
        F.when(F.col("conv_id") % 9 == 0, F.lit(0)).otherwise(F.col("turn")).alias("offset"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).alias("text"),
        F.when(F.col("turn") % 3 == 1, F.col("text")).alias("content"),
        F.when(F.col("turn") % 3 == 2, chunk).alias("chunks"),
    )
    out = feeds.assemble_pages(pages)
    return out.select("document_id", F.when(F.col("error").isNull(), F.sha2("text", 256)).alias("sha256"), "error")


ASSEMBLED_SQL = """
WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text || '!' ELSE text END AS t FROM conversations),
d AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS text, count(*) AS n FROM p GROUP BY conv_id)
SELECT conv_id AS document_id, CASE WHEN conv_id % 9 = 0 AND n > 1 THEN NULL ELSE sha256(text) END AS sha256, CASE WHEN conv_id % 9 = 0 AND n > 1 THEN 'cursor did not advance' END AS error FROM d
"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers planned for parts; a part without a known supplier reads the whole catalogue."""
    lines = _table(spark, sf_dir, "lineitem")
    plan = lines.select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("document_id"))
    catalog = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"))
    out = claims.resolve_plan(plan, catalog, _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id")))
    return out.groupBy("question_id").agg(F.count("document_id").alias("n"), F.min("document_id").alias("first"), F.max("whole").alias("whole"))


PLANS_SQL = """
WITH c AS (SELECT s_suppkey AS document_id FROM supplier),
k AS (SELECT DISTINCT l_partkey AS question_id, l_suppkey AS document_id FROM lineitem WHERE l_suppkey IN (SELECT document_id FROM c) AND l_partkey IN (SELECT p_partkey FROM part))
SELECT p_partkey AS question_id, count(document_id) AS n, min(document_id) AS first, count(document_id) = 0 AS whole
FROM part LEFT JOIN k ON question_id = p_partkey GROUP BY p_partkey
"""


def resolved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers planned for customers by the keys of their orders' parts, against the whole catalogue; what is no supplier is unknown."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("question_id"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("document_id"))
    catalog = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"))
    out = claims.resolve_plan(orders.join(lines, "o_orderkey").drop("o_orderkey"), catalog, _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id")))
    return out.groupBy("question_id").agg(F.count("document_id").alias("n"), F.min("document_id").alias("first"), F.max("whole").alias("whole"))


RESOLVED_PLANS_SQL = """
WITH k AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT s_suppkey FROM supplier))
SELECT c_custkey AS question_id, count(l_partkey) AS n, min(l_partkey) AS first, count(l_partkey) = 0 AS whole
FROM customer LEFT JOIN k ON o_custkey = c_custkey GROUP BY c_custkey
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("question_id"),
        (F.col("o_orderstatus") == "O").alias("absence"),
        (F.col("o_orderkey") % 11 == 0).alias("residual"),
        F.when(F.col("o_orderkey") % 3 == 0, "model_inference").otherwise("fact").alias("type"),
        (F.col("o_orderkey") % 2 == 0).alias("fallback_ok"),
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    return claims.close_gaps(questions, _claims(spark, sf_dir))


GAPS_SQL = """
WITH t AS (SELECT o_custkey, bool_or(o_orderstatus <> 'O') AS told FROM orders GROUP BY o_custkey)
SELECT c_custkey AS question_id, CASE WHEN told IS NULL THEN 'gap' WHEN told THEN 'answered' ELSE 'residual' END AS status FROM customer LEFT JOIN t ON o_custkey = c_custkey
"""


def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.withdrawn(_claims(spark, sf_dir)).select("claim_id", "question_id")


WITHDRAWALS_SQL = """
SELECT o_orderkey AS claim_id, o_custkey AS question_id FROM orders
WHERE o_orderstatus = 'O' AND o_orderkey % 11 <> 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')
"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim_id"))
    return claims.resolve_counter_evidence(_claims(spark, sf_dir), located)


COUNTERS_SQL = """
SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'filled'
       WHEN o_orderkey % 2 = 0 THEN 'downgraded' ELSE 'dropped' END AS status
FROM orders WHERE o_orderkey % 3 = 0
"""


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    memos = docs.select(F.col("doc_id").alias("memo_id"), F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("body"))
    verdict = F.when(F.col("doc_id") % 4 == 0, "not_addressed").otherwise("addressed")
    verdicts = docs.select(F.col("doc_id").alias("memo_id"), verdict.alias("verdict"), F.substring("text", 20, 10 + (F.col("doc_id") % 60).cast("int")).alias("locator"))
    return claims.verify_locators(verdicts, memos).select("memo_id", "verdict", "checked")


LOCATORS_SQL = r"""
WITH v AS (SELECT doc_id AS memo_id, CASE WHEN doc_id % 4 = 0 THEN 'not_addressed' ELSE 'addressed' END AS verdict, substr(text, 20, 10 + doc_id % 60) AS locator,
           regexp_extract(text, '(?s)^[^\n]*\n(.*)$', 1) AS body FROM documents)
SELECT memo_id, verdict, CASE WHEN verdict = 'not_addressed' OR (length(locator) BETWEEN 1 AND 60 AND contains(body, locator)) THEN verdict ELSE 'unverified' END AS checked FROM v
"""

QUERIES = {
    "submissions": submissions,
    "tickers": tickers,
    "announcements": announcements,
    "assembled": assembled,
    "plans": plans,
    "resolved_plans": resolved_plans,
    "gaps": gaps,
    "withdrawals": withdrawals,
    "counters": counters,
    "locators": locators,
}
ORACLES = {
    "submissions": SUBMISSIONS_SQL,
    "tickers": TICKERS_SQL,
    "announcements": ANNOUNCEMENTS_SQL,
    "assembled": ASSEMBLED_SQL,
    "plans": PLANS_SQL,
    "resolved_plans": RESOLVED_PLANS_SQL,
    "gaps": GAPS_SQL,
    "withdrawals": WITHDRAWALS_SQL,
    "counters": COUNTERS_SQL,
    "locators": LOCATORS_SQL,
}
