"""Queries over questions, recipes, tasks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import questions as q
from ..operators import recipes, scoring, tasks, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _said(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """(o_orderkey, text): one of five texts by an order's priority, with its key in place of {}."""
    text = F.element_at(F.array(*map(F.lit, texts)), F.substring("o_orderpriority", 1, 1).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.replace(text, F.lit("{}"), F.col("o_orderkey").cast("string")).alias("text"))


def _by_priority(name: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in enumerate(values, 1))
    return f"CASE substr(o_orderpriority, 1, 1) {cases} END AS {name}"


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, and whether an absence is read or stated, of a text about each order."""
    rows = _said(spark, sf_dir, ["Order {} was not disclosed", "订单 {} 未披露具体金额", "關於訂單 {} 尚無說明，無法核實", "order {} exists", "订单 {} 的金额"]).withColumn("lang", q.infer_lang(F.col("text")))
    return rows.select("o_orderkey", "lang", q.reads_as_absence(F.col("text"), F.col("lang")).alias("absent"), q.states_unverifiable(F.col("text"), F.col("lang")).alias("unverifiable"))


LANGUAGES_SQL = f"""
SELECT o_orderkey, {_by_priority("lang", ["'en'", "'zh-CN'", "'zh-TW'", "'en'", "'zh-CN'"])}, {_by_priority("absent", ["true", "true", "true", "false", "false"])},
       {_by_priority("unverifiable", ["true", "false", "true", "false", "false"])} FROM orders
"""


def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, ["When was order {} paid, and at what price per share?", "订单 {} 剩余金额占比多少", "How many shares of {} remain, what amount is left?", "who sold {}?", "案号 {} 的日期"])
    kinds, numerals = (F.array_join(x, ",") for x in (q.asked_kinds(F.col("text")), q.written_numerals(F.col("text"))))
    return rows.select("o_orderkey", kinds.alias("kinds"), q.asks_remaining(F.col("text")).alias("remaining"), numerals.alias("numerals"))


KINDS_SQL = f"""
SELECT o_orderkey, {_by_priority("kinds", ["'price,date'", "'amount,percent'", "'amount,count'", "''", "'date,doc_no'"])}, {_by_priority("remaining", ["false", "true", "true", "false", "false"])},
       CAST(o_orderkey AS VARCHAR) AS numerals FROM orders
"""


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir, ["two of {}", "百分之五 of {}", "一千零五十 万元 and {}", "５ 元, {} and Twenty percent", "五元 {}"])
    return rows.select("o_orderkey", F.array_join(q.written_numerals(F.col("text")), "|").alias("numerals"))


NUMERALS_SQL = f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
SELECT o_orderkey, {_by_priority("numerals", ["k || '|two'", "k || '|百分之五'", "k || '|一千零五十万|十万元'", "'5|' || k || '|twenty|percent'", "k || '|五元'"])} FROM o
"""


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices put in place of a name in a sentence about each order."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" 元/股")).alias("display"))
    text = F.concat(F.lit("均价为{{D1}} 元/股，上限{{D1}}，占{{D2}} 元/股"))
    return rows.select("o_orderkey", q.substitute_derivation(text, F.lit("D1"), F.col("display")).alias("text"))


DERIVATIONS_SQL = """
SELECT o_orderkey, '均价为' || p || ' 元/股，上限' || p || ' 元/股，占{{D2}} 元/股' AS text
FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)
"""


def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.window_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "index", "total", F.length("window").cast("long").alias("n_chars"), F.sha2("window", 256).alias("window_sha256"))


def chosen_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document cut into windows of 2,000 characters, the three that the first questions need."""
    focus = _table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select(F.col("text").alias("question"))
    found = windows.window_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200)
    return windows.select_windows(found, "doc_id", focus, 3).select("doc_id", "index", "total")


def chosen_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe for each part, by its name and type; brands ask for one by id, known or not."""
    held = spark.createDataFrame(
        [("a-base", None, None, True), ("b-steel", ["STEEL", "TIN"], ["a"], False), ("c-brass", ["BRASS"], ["e", "i"], False), ("d-plated", ["PLATED"], [], False)],
        "id string, question_keywords array<string>, doc_keywords array<string>, fallback boolean",
    )
    asked = F.when(F.col("p_partkey") % 50 == 0, F.lit("d-plated")).when(F.col("p_partkey") % 50 == 1, F.lit("unknown"))
    requests = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_type").alias("question"), F.col("p_name").alias("title"), asked.alias("asked_id"))
    return recipes.select_recipe(requests, held)


RECIPES_SQL = """
WITH p AS (SELECT p_partkey AS r, p_type AS q, p_name AS t FROM part),
h AS (SELECT r, q, t, CAST(contains(q, 'STEEL') AS INT) + CAST(contains(q, 'TIN') AS INT) AS b, CAST(contains(q, 'BRASS') AS INT) AS c, CAST(contains(q, 'PLATED') AS INT) AS d FROM p),
s AS (SELECT r, CASE WHEN b > 0 THEN 2 * b + CAST(contains(t, 'a') AS INT) ELSE -1 END AS sb, CASE WHEN c > 0 THEN 2 * c + CAST(contains(t, 'e') AS INT) + CAST(contains(t, 'i') AS INT) ELSE -1 END AS sc,
      CASE WHEN d > 0 THEN 2 * d ELSE -1 END AS sd FROM h)
SELECT r AS request_id,
       CASE WHEN r % 50 = 0 THEN 'd-plated' WHEN greatest(sb, sc, sd) < 0 THEN 'a-base' WHEN sb >= sc AND sb >= sd THEN 'b-steel' WHEN sc >= sd THEN 'c-brass' ELSE 'd-plated' END AS recipe_id,
       CASE WHEN r % 50 = 0 THEN 'explicit' WHEN greatest(sb, sc, sd) < 0 THEN 'fallback' ELSE 'matched' END AS selection,
       CAST(CASE WHEN r % 50 = 0 OR greatest(sb, sc, sd) < 0 THEN 0 ELSE greatest(sb, sc, sd) END AS BIGINT) AS score
FROM s WHERE r % 50 <> 1
"""


def recipe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item the conversations of a run have, items and runs by language group."""
    items = _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("run"), F.col("item_id"), F.col("text").alias("item"), F.when(F.col("item_id") % 2 == 0, "derivation").otherwise("item").alias("kind"))
    claims = _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("run"), F.col("text").alias("claim"), (F.col("role") == "system").alias("is_gap"))
    return recipes.recipe_coverage(items, claims)


_UNITS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?') || regexp_extract_all(lower({0}), '[0-9]+(?:\\.[0-9]+)?'))"
ITEMS_SQL = rf"""
WITH i AS (SELECT item_id % 5 AS run, item_id, item_id % 2 = 0 AS derived, list_filter({_UNITS.format("text")}, lambda u: u NOT IN ('the', 'of', 'is', 'are', 'what', 'which', 'company')) AS w FROM benchmark),
c AS (SELECT conv_id % 5 AS run, conv_id || '-' || turn AS k, {_UNITS.format("text")} AS u FROM conversations WHERE role <> 'system'),
e AS (SELECT run, k, unnest(u) AS unit FROM c), t AS (SELECT run, item_id, derived, unnest(w) AS unit FROM i),
a AS (SELECT run, item_id, count(DISTINCT unit) AS n FROM t JOIN e USING (run, unit) WHERE NOT derived GROUP BY ALL),
d AS (SELECT run, item_id, max(n) AS n FROM (SELECT run, item_id, k, count(*) AS n FROM t JOIN e USING (run, unit) WHERE derived GROUP BY ALL) GROUP BY ALL),
m AS (SELECT * FROM a UNION ALL SELECT * FROM d),
s AS (SELECT run, item_id, derived, CASE WHEN len(w) = 0 THEN 1.0 ELSE coalesce(n, 0) * 1.0 / len(w) END AS share FROM i LEFT JOIN m USING (run, item_id))
SELECT run, item_id, round(share, 6) AS share, share >= CASE WHEN derived THEN 0.5 ELSE 0.4 END AS covered FROM s
"""


def questions_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name and type, as a question of their brand, the names and types of its smallest parts do not cover."""
    part = _table(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("run"), F.concat_ws(" ", "p_type", "p_name").alias("text"), "p_size")
    least = asked.groupBy("run").agg(F.min("p_size").alias("p_size"))
    asked = asked.join(least, ["run", "p_size"]).select("run", "text").distinct()
    wanted = part.select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("question_id"), F.concat("p_name", F.lit("? "), "p_type").alias("question"))
    return recipes.missing_questions(wanted, asked).select("run", "question_id")


MISSING_SQL = rf"""
WITH l AS (SELECT p_brand AS run, min(p_size) AS p_size FROM part GROUP BY p_brand),
a AS (SELECT DISTINCT p_brand AS run, {_UNITS.format("p_type || ' ' || p_name")} AS u FROM part JOIN l ON l.run = p_brand AND l.p_size = part.p_size),
c AS (SELECT p_brand AS run, p_partkey AS question_id, unnest([p_name, p_type]) AS clause FROM part),
w AS (SELECT run, question_id, clause, {_UNITS.format("clause")} AS w FROM c WHERE length(trim(clause)) >= 4),
m AS (SELECT w.run, question_id, clause, max(len(list_intersect(w, u)) * 1.0 / len(w)) AS best FROM w LEFT JOIN a ON a.run = w.run GROUP BY ALL)
SELECT DISTINCT run, question_id FROM m WHERE coalesce(best, 0) < 0.6
"""


def task_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of tasks made of documents, with labels as points, and benchmark passages as quotes of the documents that may hold them."""
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("task"), "lang", F.when(F.col("n_chars") > 5000, "multi_doc").otherwise("fact").alias("type"), F.substring("text", 1, 40).alias("prompt"), F.array("source").alias("context_files"))
    points = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task"), F.lit("K1").alias("point_id"))
    first = docs.select(F.col("doc_id").alias("task"), F.lit("K1").alias("point_id"), F.substring("text", 11, 20).alias("quote"), F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.col("source")).alias("source_file"))
    contexts = docs.select(F.col("doc_id").alias("task"), F.col("source").alias("path"), "text")
    found = tasks.validate_tasks(rows, points, first, contexts)
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("reference").alias("first_reference"))


TASKS_SQL = r"""
WITH v AS (
  SELECT 'no_prompt' AS code, doc_id || ':' || lang AS reference FROM documents WHERE trim(substr(text, 1, 40), ' ') = ''
  UNION ALL SELECT 'unknown_language', doc_id || ':' || lang FROM documents WHERE lang <> 'en'
  UNION ALL SELECT 'few_contexts', doc_id || ':' || lang FROM documents WHERE n_chars > 5000
  UNION ALL SELECT 'unknown_point', doc_id || ':K1' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'unknown_source', doc_id || ':K1' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'unquoted', doc_id || ':K1' FROM documents WHERE doc_id % 3 = 0
)
SELECT code, count(*) AS n, min(reference) AS first_reference FROM v GROUP BY code
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of an answer about each order: complete, missing or advice by its status; urgent orders must be refused."""
    orders = _table(spark, sf_dir, "orders")
    task, key = F.col("o_orderkey").alias("task"), F.col("o_orderkey").cast("string")
    price = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" 万元"))
    full = F.concat(F.lit("Order "), key, F.lit(" was delivered in full, however a risk of delay remains \"the goods of order "), key, F.lit(" were delivered\" (context/a.txt) for "), price)
    output = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderstatus") == "O", F.lit(" ")).otherwise(F.concat(F.lit("You should buy order "), key, F.lit(".")))
    answers = orders.select(F.col("o_orderkey").alias("answer_id"), task, output.alias("output"), F.lit(None).cast("string").alias("error"))
    held = orders.select(task, F.array(*map(F.lit, scoring.DIMENSIONS)).alias("scoring"), (F.col("o_orderpriority") == "1-URGENT").alias("must_refuse"))
    points = orders.select(task, F.lit("K1").alias("point_id"), F.concat(F.lit("order "), key, F.lit(" was delivered in full")).alias("point"), F.lit(True).alias("required"))
    gold = {
        "numbers": orders.select(task, F.lit("N1").alias("gold_id"), price.alias("verbatim"), (F.col("o_totalprice").cast("decimal(18,2)") * 10000).cast("decimal(28,0)").cast("string").alias("value"), F.lit("CNY").alias("unit"), F.lit(False).alias("derived")),
        "points": points,
        "evidence": orders.select(task, F.lit("E1").alias("evidence_id"), F.lit("K1").alias("point_id"), F.array(F.concat(F.lit("the goods of order "), key, F.lit(" were delivered"))).alias("quotes"), F.lit("context/a.txt").alias("source_file")),
        "required": points.select("task", "point_id"),
        "forbidden": spark.createDataFrame([], "task long, phrase string"),
        "sources": orders.select(task, F.concat(F.lit("order "), key).alias("text")),
    }
    return scoring.score_responses(answers, held, gold)


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("task", "absence", "absence_failure").withColumnRenamed("answer_id", "o_orderkey")


SCORED_SQL = """
WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AS urgent, CAST(o_orderstatus = 'F' AS DOUBLE) AS whole FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'O' THEN 'agent returned empty output' END AS failure_reason,
       CAST(o_orderstatus <> 'O' AS DOUBLE) AS number_fidelity, whole AS citation_alignment, whole AS counterevidence, whole AS compliance, whole AS completeness,
       CAST(CASE WHEN o_orderstatus = 'O' OR urgent THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 0.2 END AS DOUBLE) AS overall,
       CASE WHEN NOT urgent THEN NULL WHEN o_orderstatus = 'O' THEN 'agent_failed' ELSE 'actionable_or_not_refused' END AS outcome
FROM o
"""


def trap_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which limits of planted answers hold: of one answer for each order."""
    limits = spark.createDataFrame([("overall_max", "0.5"), ("number_fidelity_min", "0.9"), ("compliance", "fail"), ("completeness", "1"), ("unheard_of", "1")], "key string, expected string")
    scores = _scored(spark, sf_dir)
    planted = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")).crossJoin(F.broadcast(limits))
    return scoring.check_traps(scores, planted).groupBy(F.col("task").alias("o_orderkey")).agg(*(F.max(F.when(F.col("key") == k, F.col("holds"))).alias(k) for k in ("overall_max", "number_fidelity_min", "compliance", "completeness", "unheard_of")))


TRAPS_SQL = """
SELECT o_orderkey, NOT (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS overall_max, o_orderstatus <> 'O' AS number_fidelity_min,
       o_orderstatus <> 'F' AS compliance, o_orderstatus = 'F' AS completeness, false AS unheard_of FROM orders
"""

QUERIES = {
    "languages": languages,
    "question_kinds": question_kinds,
    "numerals": numerals,
    "derivations": derivations,
    "document_windows": document_windows,
    "chosen_windows": chosen_windows,
    "chosen_recipes": chosen_recipes,
    "recipe_items": recipe_items,
    "questions_missing": questions_missing,
    "task_violations": task_violations,
    "scored_answers": scored_answers,
    "trap_limits": trap_limits,
}
ORACLES = {
    "languages": LANGUAGES_SQL,
    "question_kinds": KINDS_SQL,
    "numerals": NUMERALS_SQL,
    "derivations": DERIVATIONS_SQL,
    "chosen_recipes": RECIPES_SQL,
    "recipe_items": ITEMS_SQL,
    "questions_missing": MISSING_SQL,
    "task_violations": TASKS_SQL,
    "scored_answers": SCORED_SQL,
    "trap_limits": TRAPS_SQL,
}
