"""Queries that score answers: figures, advice, citations and the whole.

Answers are built from orders and documents, so that what they state, and so
every score, follows from columns that the SQL reads without parsing a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import normal_text
from ..functions.numbers import declared_units, explode_numbers
from ..operators import compliance, fidelity, scoring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _thousands(number: Column) -> Column:
    return F.format_number(number, 2)


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a sentence about each order."""
    text = F.concat(F.lit("On "), "day", F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" came to "), _thousands(F.col("price")), F.lit(" 万元, up 12.50%, i.e. HKD "), F.col("price").cast("string"), F.lit(" million and 3 倍."))
    rows = explode_numbers(_orders(spark, sf_dir).select("o_orderkey", text.alias("text")), "text")
    return rows.select("o_orderkey", F.col("place").cast("long").alias("place"), "kind", "value", "unit", "numeric_raw", F.col("power").cast("long").alias("power"))


_PLAIN = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
NUMBER_TOKENS_SQL = rf"""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT o_orderkey, CAST(0 AS BIGINT) AS place, 'date' AS kind, day AS value, 'date' AS unit, NULL AS numeric_raw, CAST(NULL AS BIGINT) AS power FROM o
UNION ALL SELECT o_orderkey, 1, 'scalar', CAST(o_orderkey AS VARCHAR), 'scalar', NULL, NULL FROM o
UNION ALL SELECT o_orderkey, 2, 'amount', {_PLAIN.format("price * 10000")}, 'CNY', {_PLAIN.format("price")}, 4 FROM o
UNION ALL SELECT o_orderkey, 3, 'percent', '12.5', 'percent', NULL, NULL FROM o
UNION ALL SELECT o_orderkey, 4, 'amount', {_PLAIN.format("price * 1000000")}, 'HKD', {_PLAIN.format("price")}, 6 FROM o
UNION ALL SELECT o_orderkey, 5, 'scalar', '3', 'multiple', NULL, NULL FROM o
"""


def _fidelity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(answers, judged figures): an order's answer gives its total in the right unit, in another, or wrongly, by its status."""
    orders = _orders(spark, sf_dir)
    label = F.when(F.col("o_orderstatus") == "O", F.lit(" 亿元")).otherwise(F.lit(" 万元"))
    figure = F.when(F.col("o_orderstatus") == "P", F.col("price") + 1).otherwise(F.col("price"))
    year = F.when(F.col("o_orderstatus") == "P", F.lit(" until 2031")).otherwise(F.lit(""))
    output = F.concat(F.lit("A total of "), _thousands(figure), label, F.lit(" on "), "day", year, F.lit("; a part of 1,234.50 万元."))
    answers = orders.select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderkey").alias("task"), output.alias("output"))
    gold = orders.select(F.col("o_orderkey").alias("task"), F.lit("N1").alias("gold_id"), F.concat(F.col("price").cast("string"), F.lit(" 万元")).alias("verbatim"), (F.col("price") * 10000).cast("decimal(28,0)").cast("string").alias("value"), F.lit("CNY").alias("unit"), F.lit(False).alias("derived"))
    sources = orders.select(F.col("o_orderkey").alias("task"), F.concat(F.lit("单位：万元\nDated "), "day", F.lit(" 1,234.5")).alias("text"))
    return answers, fidelity.judge_numbers(answers, gold, sources)


def number_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _fidelity(spark, sf_dir)[1]
    return judged.groupBy(F.col("answer_id").alias("o_orderkey"), "verdict").agg(F.count("*").alias("n"))


NUMBER_VERDICTS_SQL = """
SELECT o_orderkey, 'source' AS verdict, CAST(1 AS BIGINT) AS n FROM orders
UNION ALL SELECT o_orderkey, 'declared', 1 FROM orders
UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'unit_mismatch' WHEN 'P' THEN 'fabricated' ELSE 'gold' END, 1 FROM orders
UNION ALL SELECT o_orderkey, 'unlisted_year', 1 FROM orders WHERE o_orderstatus = 'P'
"""


def number_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, judged = _fidelity(spark, sf_dir)
    return fidelity.number_fidelity(answers, judged).select(F.col("answer_id").alias("o_orderkey"), "n_valid", "n_mismatch", "n_fabricated", "n_years", "score")


NUMBER_FIDELITY_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN CAST(2 AS BIGINT) ELSE 3 END AS n_valid,
       CAST(o_orderstatus = 'O' AS BIGINT) AS n_mismatch, CAST(o_orderstatus = 'P' AS BIGINT) AS n_fabricated, CAST(o_orderstatus = 'P' AS BIGINT) AS n_years,
       CAST(CASE o_orderstatus WHEN 'O' THEN 0.5 WHEN 'P' THEN round(2.0 / 3 - 0.1, 6) ELSE 1.0 END AS DOUBLE) AS score
FROM orders
"""


def declared_table_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that an order's table declares, by its priority."""
    label = F.element_at(F.array(*map(F.lit, ("万元", "億元", "千元", "人民币元", "件"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    text = F.concat(F.lit("表 1 單位: "), label, F.lit("\n单位："), label, F.lit(" 单位：万亿元"))
    return declared_units(_orders(spark, sf_dir).select("o_orderkey", text.alias("text")), "text").select("o_orderkey", "unit", F.col("power").cast("long").alias("power"))


DECLARED_SQL = """
SELECT o_orderkey, 'CNY' AS unit, CAST(12 AS BIGINT) AS power FROM orders
UNION ALL SELECT o_orderkey, 'CNY', CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 8 WHEN '3' THEN 3 ELSE 0 END
FROM orders WHERE substr(o_orderpriority, 1, 1) <> '5'
"""


def advice_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compliance of an answer for each order: by its priority it advises, refuses, restates or does neither."""
    said = [
        "I think you should buy order {}; a price target follows.",
        "I cannot recommend that you buy it, because order {} is a risk.",
        'The user asked whether "should buy" fits order {}.',
        "不能抄底但可以定投 {}。目标价",
        "Order {} was paid in full.",
    ]
    text = F.element_at(F.array(*map(F.lit, said)), F.substring("o_orderpriority", 1, 1).cast("int"))
    orders = _orders(spark, sf_dir)
    answers = orders.select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderpriority").alias("task"), F.replace(text, F.lit("{}"), F.col("o_orderkey").cast("string")).alias("output"))
    phrases = spark.createDataFrame([("5-LOW", "PAID in full")], "task string, phrase string")
    sources = spark.createDataFrame([], "task string, text string")
    scored = compliance.score_compliance(answers, phrases, sources)
    return scored.select(F.col("answer_id").alias("o_orderkey"), "n_hits", "refusal", "refusal_explained", "score")


ADVICE_SQL = """
SELECT o_orderkey, CAST(CASE p WHEN '1' THEN 2 WHEN '4' THEN 2 WHEN '5' THEN 1 ELSE 0 END AS BIGINT) AS n_hits,
       p IN ('2', '4') AS refusal, p IN ('2') AS refusal_explained, CAST(CASE WHEN p IN ('1', '4', '5') THEN 0.0 ELSE 1.0 END AS DOUBLE) AS score
FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p FROM orders)
"""


def normal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = normal_text(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n_normal"), F.sha2(text, 256).alias("normal_sha256"))


NORMAL_SQL = r"""
SELECT doc_id, length(t) AS n_normal, sha256(t) AS normal_sha256
FROM (SELECT doc_id, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g') AS t FROM documents)
"""

# Ten characters in both scripts: a point is an order's total in simplified ones.
_SIMPLE, _OTHER, _DIGITS = "价单发号总资对数时间", "價單發號總資對數時間", "0123456789"


def folded_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in simplified characters and answers in traditional ones: the whole point, half of it, or its reverse."""
    digits = F.regexp_replace(F.col("price").cast("string"), r"\.", "")
    part = F.element_at(F.array(digits, F.substr(digits, F.lit(1), F.floor(F.length(digits) / 2).cast("int")), F.reverse(digits)), (F.col("o_orderkey") % 3).cast("int") + 1)
    orders = _orders(spark, sf_dir)
    task = F.col("o_orderkey").alias("task")
    answers = orders.select(F.col("o_orderkey").alias("answer_id"), task, F.translate(part, _DIGITS, _OTHER).alias("output"))
    points = orders.select(task, F.lit("K2").alias("point_id"), F.translate(digits, _DIGITS, _SIMPLE).alias("point"), F.lit(True).alias("required"))
    refusals = orders.select(F.col("o_orderkey").alias("answer_id"), F.lit(False).alias("refusal_explained"))
    both = scoring.completeness(answers, points, refusals, (_OTHER, _SIMPLE)).join(scoring.completeness(answers, points, refusals).withColumnRenamed("completeness", "unfolded"), "answer_id")
    return both.select(F.col("answer_id").alias("o_orderkey"), "completeness", "unfolded")


FOLDED_SQL = f"""
WITH o AS (SELECT o_orderkey, replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', '') AS d FROM orders),
t AS (SELECT o_orderkey, translate(d, '{_DIGITS}', '{_SIMPLE}') AS point, translate(CASE o_orderkey % 3 WHEN 0 THEN d WHEN 1 THEN substring(d, 1, length(d) // 2) ELSE reverse(d) END, '{_DIGITS}', '{_OTHER}') AS answer FROM o),
f AS (SELECT o_orderkey, point, answer, translate(answer, '{_OTHER}', '{_SIMPLE}') AS folded FROM t),
g AS (SELECT o_orderkey,
        list_distinct(list_transform(range(1, length(point)), lambda i: substring(point, i, 2))) AS wanted,
        list_distinct(list_transform(range(1, length(folded)), lambda i: substring(folded, i, 2))) AS said,
        list_distinct(list_transform(range(1, length(answer)), lambda i: substring(answer, i, 2))) AS plain FROM f)
SELECT o_orderkey, CAST(2 * len(list_intersect(wanted, said)) >= len(wanted) AS DOUBLE) AS completeness, CAST(2 * len(list_intersect(wanted, plain)) >= len(wanted) AS DOUBLE) AS unfolded FROM g
"""

QUERIES = {
    "folded_completeness": folded_completeness,
    "number_tokens": number_tokens,
    "number_verdicts": number_verdicts,
    "number_fidelity": number_fidelity,
    "declared_table_units": declared_table_units,
    "advice_hits": advice_hits,
    "normal_documents": normal_documents,
}
ORACLES = {
    "folded_completeness": FOLDED_SQL,
    "number_tokens": NUMBER_TOKENS_SQL,
    "number_verdicts": NUMBER_VERDICTS_SQL,
    "number_fidelity": NUMBER_FIDELITY_SQL,
    "declared_table_units": DECLARED_SQL,
    "advice_hits": ADVICE_SQL,
    "normal_documents": NORMAL_SQL,
}
