"""Queries over checks, reports and the stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_passages
from ..operators import checks, reports
from ..operators.scoring import COUNTER_MARKS
from ..streaming.scores import latest_scores, stream_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references among orders, lines, parts and suppliers, and orders without lines."""
    t = {n: _table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "customer")}
    parts = [
        checks.dangling(t["lineitem"].where("l_linenumber > 1"), ["l_orderkey"], t["lineitem"].where("l_linenumber = 1"), ["l_orderkey"], "no_first_line"),
        checks.dangling(t["lineitem"], ["l_orderkey"], t["orders"].where("o_orderstatus = 'F'"), ["o_orderkey"], "order_not_final"),
        checks.dangling(t["orders"], ["o_orderkey"], t["lineitem"], ["l_orderkey"], "empty_order"),
        checks.dangling(t["customer"], ["c_custkey"], t["orders"], ["o_custkey"], "unused_customer"),
        checks.repeated(t["lineitem"], ["l_partkey", "l_suppkey"], "repeated_pair"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("reference").alias("n_references"), F.min("reference").alias("first_reference"))


CONTRACT_SQL = """
WITH v AS (
  SELECT 'no_first_line' AS code, CAST(l_orderkey AS VARCHAR) AS reference FROM lineitem WHERE l_linenumber > 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
  UNION ALL SELECT 'order_not_final', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT 'empty_order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'unused_customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'repeated_pair', l_partkey || ':' || l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
)
SELECT code, count(*) AS n, count(DISTINCT reference) AS n_references, min(reference) AS first_reference FROM v GROUP BY code
"""


def ngram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.contamination(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "benchmark"), "item_id")


CONTAMINATION_SQL = r"""
WITH g AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark),
asked AS (SELECT DISTINCT item_id, substr(t, i, 8) AS gram FROM (SELECT item_id, t, unnest(generate_series(1, length(t) - 7, 4)) AS i FROM g)),
d AS (SELECT regexp_replace(text, '\s+', '', 'g') AS t FROM documents),
held AS (SELECT DISTINCT substr(t, i, 8) AS gram FROM (SELECT t, unnest(generate_series(1, length(t) - 7)) AS i FROM d))
SELECT item_id, count(*) AS n_grams, count(held.gram) AS n_found FROM asked LEFT JOIN held USING (gram) GROUP BY item_id
"""


def quoted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.quoted_in(_table(spark, sf_dir, "documents"), "doc_id", _table(spark, sf_dir, "benchmark"), "item_id")


QUOTED_SQL = "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0"


def neighbour_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the lines before and after each line that has `as`."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("conv_id", "turn").orderBy("line_no")
    rows = rows.withColumn("before", F.length(F.lag("line").over(w))).withColumn("after", F.length(F.lead("line").over(w)))
    return rows.where(F.col("line").contains("as")).select("conv_id", "turn", "line_no", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


NEIGHBOUR_SQL = """
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations),
r AS (SELECT conv_id, turn, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM l),
n AS (SELECT *, length(lag(line) OVER w) AS before, length(lead(line) OVER w) AS after FROM r WINDOW w AS (PARTITION BY conv_id, turn ORDER BY line_no))
SELECT conv_id, turn, line_no, before, after FROM n WHERE contains(line, 'as')
"""


def open_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_passages(F.col("text"))).alias("passage_no", "passage"))
    joined = checks.join_open(passages, ["doc_id"], "passage_no", "passage")
    return joined.select("doc_id", "passage_no", F.length("passage").alias("n_chars"), F.length("joined").alias("n_joined"), F.sha2("joined", 256).alias("joined_sha256"))


MARKER = r"(?i)(?:however|risk|uncertain|the)"


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = turns.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), (F.col("conv_id") % 20).alias("task"), F.col("text").alias("output"))
    points = _table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("task"), F.col("item_id").alias("point_id"), F.col("text").alias("point"))
    return answers, points


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.points_covered(*_answers(spark, sf_dir), "task", 0.1)


def counterevidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.points_covered(*_answers(spark, sf_dir), "task", 0.05, MARKER)


def _points_sql(least: float, marker: str) -> str:
    units = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?') || regexp_extract_all(lower({0}), '[0-9]+(?:\\.[0-9]+)?'))"
    return rf"""
WITH a AS (SELECT conv_id || '-' || turn AS answer_id, conv_id % 20 AS task, text FROM conversations WHERE role = 'assistant'),
l AS (SELECT answer_id, task, unnest(string_split(text, chr(10))) AS line FROM a),
lu AS (SELECT answer_id, task, {units.format("line")} AS us FROM l WHERE regexp_matches(line, '\S') {marker}),
p AS (SELECT item_id % 20 AS task, item_id, {units.format("text")} AS ws FROM benchmark),
m AS (SELECT answer_id, item_id, max(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_intersect(ws, us)) * 1.0 / len(ws) END) AS c FROM lu JOIN p USING (task) GROUP BY ALL),
h AS (SELECT answer_id, count(*) AS k FROM m WHERE c >= {least} GROUP BY answer_id),
n AS (SELECT task, count(*) AS n FROM p GROUP BY task)
SELECT answer_id, coalesce(n, 0) AS n_points, coalesce(k, 0) AS n_covered, CASE WHEN n IS NULL THEN 1.0 ELSE round(CAST(coalesce(k, 0) AS DOUBLE) / n, 6) END AS score
FROM a LEFT JOIN n USING (task) LEFT JOIN h USING (answer_id)
"""


def point_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which the whole answer has half of the units."""
    return checks.points_covered(*_answers(spark, sf_dir), "task", 0.5, whole=True)


def point_counterevidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which a line with a mark of counter-evidence has a quarter of the units."""
    return checks.points_covered(*_answers(spark, sf_dir), "task", 0.25, COUNTER_MARKS)


# A distinct formulation: every answer or line is paired with every point of its task, and units are counted row by row.
_POINT_UNITS_SQL = r"""
  SELECT {id}, unnest(list_distinct(regexp_extract_all(lower({text}), '[a-z]+(?:''[a-z]+)?') || regexp_extract_all(lower({text}), '[0-9]+(?:\.[0-9]+)?'))) AS unit FROM {rows}
"""


def _whole_points_sql(rows: str, least: str) -> str:
    return rf"""
WITH a AS (SELECT conv_id || '-' || turn AS answer_id, conv_id % 20 AS task, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
r AS ({rows}),
u AS ({_POINT_UNITS_SQL.format(id="answer_id, part_no", text="part", rows="r")}),
w AS ({_POINT_UNITS_SQL.format(id="item_id", text="text", rows="benchmark")}),
s AS (SELECT item_id, count(*) AS size FROM w GROUP BY item_id),
pairs AS (SELECT answer_id, part_no, item_id, coalesce(size, 0) AS size FROM r JOIN a USING (answer_id) JOIN benchmark ON item_id % 20 = a.task LEFT JOIN s USING (item_id)),
shared AS (SELECT answer_id, part_no, item_id, count(*) AS k FROM u JOIN w USING (unit) GROUP BY ALL),
hit AS (SELECT DISTINCT answer_id, item_id FROM pairs LEFT JOIN shared USING (answer_id, part_no, item_id) WHERE size = 0 OR coalesce(k, 0) >= {least} * size),
h AS (SELECT answer_id, count(*) AS k FROM hit GROUP BY answer_id),
n AS (SELECT item_id % 20 AS task, count(*) AS n FROM benchmark GROUP BY ALL)
SELECT answer_id, coalesce(n, 0) AS n_points, coalesce(k, 0) AS n_covered, CASE WHEN n IS NULL THEN 1.0 ELSE round(CAST(coalesce(k, 0) AS DOUBLE) / n, 6) END AS score
FROM a LEFT JOIN n USING (task) LEFT JOIN h USING (answer_id)
"""


POINT_COMPLETENESS_SQL = _whole_points_sql("SELECT answer_id, 0 AS part_no, text AS part FROM a", "0.5")
POINT_COUNTEREVIDENCE_SQL = _whole_points_sql(
    f"SELECT * FROM (SELECT answer_id, generate_subscripts(string_split(text, chr(10)), 1) AS part_no, unnest(string_split(text, chr(10))) AS part FROM a) WHERE regexp_matches(part, '{COUNTER_MARKS}')",
    "0.25",
)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality", "toxic")
    return reports.build_report(scores, ["quality", "toxic"])


REPORT_SQL = """
WITH s AS (SELECT lang, 'quality' AS dimension, CAST(quality AS DOUBLE) AS value FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT lang, 'toxic', CAST(toxic AS DOUBLE) FROM documents JOIN labels USING (doc_id))
SELECT dimension, lang, count(*) AS n, round(avg(value), 6) AS mean FROM s WHERE value IS NOT NULL GROUP BY CUBE (dimension, lang)
"""


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    scores = events.select((F.col("user_id") % 3).alias("lang"), F.col("event_type").alias("agent"), (F.col("event_id") % 4).alias("run"), F.col("value").alias("overall"))
    return reports.compare_runs(scores, ["view", "click"])


COMPARISON_SQL = """
WITH r AS (SELECT user_id % 3 AS lang, event_type AS agent, event_id % 4 AS run, avg(value) AS mean FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
g AS (SELECT lang, agent, round(avg(mean), 6) AS m, round(max(mean) - min(mean), 6) AS s FROM r GROUP BY lang, agent)
SELECT lang, max(m) FILTER (agent = 'view') AS first_mean, max(m) FILTER (agent = 'click') AS second_mean,
       round(max(m) FILTER (agent = 'view') - max(m) FILTER (agent = 'click'), 6) AS delta,
       max(s) FILTER (agent = 'view') AS first_spread, max(s) FILTER (agent = 'click') AS second_spread
FROM g GROUP BY lang
"""


def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("char_start"), "l_orderkey")
    return reports.intern_evidence(lines, "run", ["document_id", "char_start"], ["l_orderkey"])


EVIDENCE_SQL = """
WITH f AS (SELECT l_suppkey AS run, l_partkey AS document_id, l_linenumber AS char_start, min(l_orderkey) AS first FROM lineitem GROUP BY ALL)
SELECT run, document_id, char_start, 'E' || row_number() OVER (PARTITION BY run ORDER BY first, document_id, char_start) AS evidence_id FROM f
"""


def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("claim_no", "text"))
    first, second = lines.where("turn % 2 = 1"), lines.where("turn % 2 = 0")
    return reports.merge_rounds(first, second, "conv_id", ["turn", "claim_no"]).select("conv_id", "turn", "claim_no", F.trim("text").alias("claim"))


MERGED_SQL = """
WITH s AS (SELECT conv_id, turn, string_split(text, '.') AS x FROM conversations),
l AS (SELECT conv_id, turn, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS claim_no FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, trim(text, ' ') ORDER BY 1 - turn % 2, turn, claim_no) AS k FROM l)
SELECT conv_id, turn, claim_no, trim(text, ' ') AS claim FROM r WHERE k = 1
"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"))


SUMMARY_SQL = "SELECT event_type AS step, count(*) AS calls, round(sum(value), 2) AS tokens FROM events GROUP BY event_type"


def top_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("claim_id"), "text")
    return reports.risk_claims(claims, "conv_id", r"the|der|les").select("conv_id", "claim_id", "n_risk", "place")


RISK_SQL = """
WITH c AS (SELECT conv_id, turn AS claim_id, CAST(len(regexp_extract_all(lower(text), 'the|der|les')) AS BIGINT) AS n_risk FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n_risk DESC, claim_id) AS place FROM c WHERE n_risk > 0)
SELECT * FROM r WHERE place <= 3
"""


def _streamed(spark: SparkSession, sf_dir: str, least: float, whole: bool) -> DataFrame:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="stream-")
    base = f"{folder}/scores-{uuid.uuid4().hex}"
    answers, points = _answers(spark, sf_dir)
    answers.write.parquet(f"{base}/in")
    stream_scores(spark, f"{base}/in", answers.schema, lambda batch: checks.points_covered(batch, points, "task", least, whole=whole), f"{base}/out", f"{base}/state")
    return latest_scores(spark, f"{base}/out", ["answer_id"])


def streamed_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`completeness` of responses that arrive as files."""
    return _streamed(spark, sf_dir, 0.1, False)


def streamed_point_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`point_completeness` of responses that arrive as files."""
    return _streamed(spark, sf_dir, 0.5, True)


QUERIES = {
    "contract_violations": contract_violations,
    "ngram_contamination": ngram_contamination,
    "quoted_documents": quoted_documents,
    "neighbour_passages": neighbour_passages,
    "open_passages": open_passages,
    "completeness": completeness,
    "counterevidence": counterevidence,
    "report": report,
    "run_comparison": run_comparison,
    "evidence_pool": evidence_pool,
    "merged_claims": merged_claims,
    "run_summary": run_summary,
    "top_risk": top_risk,
    "streamed_completeness": streamed_completeness,
    "point_completeness": point_completeness,
    "point_counterevidence": point_counterevidence,
    "streamed_point_completeness": streamed_point_completeness,
}
ORACLES = {
    "contract_violations": CONTRACT_SQL,
    "ngram_contamination": CONTAMINATION_SQL,
    "quoted_documents": QUOTED_SQL,
    "neighbour_passages": NEIGHBOUR_SQL,
    "completeness": _points_sql(0.1, ""),
    "counterevidence": _points_sql(0.05, f"AND regexp_matches(line, '{MARKER}')"),
    "report": REPORT_SQL,
    "run_comparison": COMPARISON_SQL,
    "evidence_pool": EVIDENCE_SQL,
    "merged_claims": MERGED_SQL,
    "run_summary": SUMMARY_SQL,
    "top_risk": RISK_SQL,
    "streamed_completeness": _points_sql(0.1, ""),
    "point_completeness": POINT_COMPLETENESS_SQL,
    "point_counterevidence": POINT_COUNTEREVIDENCE_SQL,
    "streamed_point_completeness": POINT_COMPLETENESS_SQL,
}
