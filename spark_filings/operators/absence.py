"""Answers to questions that the sources leave open: honest, supported, or made up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Script, normal_text, scoring_units
from ..functions.places import places, without_marks
from ..functions.text import coverage
from .citations import citations

# Wording of absence, of its explanation and of blanket
# statements, roles that someone may be given, forms of questions and of units.
ABSENCE = (
    r"(?i)(?:未(?:予|曾|能)?(?:披露|揭露)|没有(?:披露|说明|提及|明确)|"
    r"尚未|仍未|暂未|暂无|尚无|不详|未说明|未提及|未明确|查无|"
    r"无法(?:核实|确认|判断|得知|从[^，。；;\n]{0,20}得出)|无从得知|"
    r"无(?:相关|对应|此类)?(?:信息|资料)|原文未|公告未|材料未|未指定|未确定|"
    r"沒有(?:披露|說明|提及|明確)|無法(?:核實|確認|判斷|得知)|暫無|尚無|不詳|查無|"
    r"未(?:予|曾|能)?(?:說明|提及|明確|指定|確定)|原文未|公告未|資料未|無從得知|"
    r"未在[^，。；;\n]{0,16}中(?:披露|揭露|确定|確定|说明|說明)|"
    r"not\s+(?:yet\s+)?(?:disclosed|stated|available|verifiable|determined|specified|finali[sz]ed|set|named|designated|identified)|"
    r"(?:do(?:es)?|did)\s+not\s+(?:disclose|designate|name|state|specify|identify|provide|mention)|"
    r"\bnor\s+(?:the|any|does|did)\b|"
    r"(?:remains?|is)\s+undetermined|to\s+be\s+determined|\bTBD\b|"
    r"cannot\s+(?:verify|determine|confirm))"
)
EXPLAINED = r"(?i)(?:立案审查|申请阶段|尚处|未受理|尚未受理|未进入|未指定|程序|重大不确定|能否被受理|截至本公告披露日)"
BLANKET = r"(?i)(?:前三项|前3项|问题?\s*1\s*(?:[-~至到]至?)?\s*3|上述三项|上述3项|第[123]问(?:均|都).{0,8})(?:[^\n。；;]{0,20})(?:未披露|尚未|无法核实|暂无)"
ROLES = ("重整投资人", "重整管理人", "投资人", "管理人")
TOPICS = ("重整投资人", "投资人", "出资金额", "出资", "重整管理人", "管理人")
GIVEN = (
    r"(?:名称|名单|名單)?\s*(?:已\s*)?(?:确定|指定|选定|確定|指定)?\s*(?:为|是|由|包括|[:：=])\s*"
    r"(?!谁|什么|什麼|哪|未|尚|无法|沒有|不详|待定|暂无|公告未|原文未|不超过|不超過)([^，,。；;\n\]}】]{1,60})"
)
TAKES = r"((?:由\s*)?[A-Za-z\x{3400}-\x{9fff}][A-Za-z0-9\x{3400}-\x{9fff}·・\s]{1,40}?)(?:将|已)?\s*(?:担任|擔任|作为|作為|系|係)\s*"
QUESTION = r"[？?]|(?:多少|几多|哪些|哪家|哪几|哪幾|几家|幾家|什么|什麼|是谁|是誰|何时|何時|吗$|嗎$)"
_LABEL = r"(?:人民币|人民幣)?(?:万亿元|萬億元|亿元|億元|百万元|百萬元|万元|萬元|千元|元|万港元|萬港元|港元|万美元|萬美元|美元)"
_VALUE = rf"(?:\d[\d,]*(?:\.\d+)?\s*)?{_LABEL}"
UNIT_ONLY = (
    r"(?i)^\s*in\s+(?:(?:rmb|cny)(?:\s*/\s*(?:rmb|cny))?\s+)?(?:(?:\d[\d,]*(?:\.\d+)?|[a-z]+)\s+)?(?:thousand|million|billion|trillion)(?:\s+(?:yuan|rmb|cny|dollars?))?\s*$"
    rf"|^\s*(?:[单位單位]\s*[:：]\s*{_VALUE}|{_VALUE}\s*为单位)\s*$"
)
PAID = r"(?:出资|投资金额|承诺金额)[^，,。；;\n]{0,20}(?:为|是|达|達|共|计|計|[:：])?"

#: Share of a question's units from which a segment speaks of it, and what an honest answer is worth with and without support.
MENTIONED = 0.34
SUPPORTED, HONEST = 1.0, 0.75


def is_question(line: Column) -> Column:
    """Whether a line only restates a question: one in bold, or a heading that asks."""
    text = F.trim(line)
    heading = F.regexp_replace(text, r"^#{1,6}\s+", "")
    return text.rlike(r"^\*\*.*[？?]\*\*$") | (text.rlike(r"^#{1,6}\s+") & heading.rlike(QUESTION) & heading.rlike(r"[？?]$"))


def is_unit_only(content: Column) -> Column:
    """Whether what stands in brackets gives nothing but a unit."""
    return content.rlike(UNIT_ONLY)


def _speaks_of(segment: Column, units: Column, normal: Column) -> Column:
    """Whether a segment speaks of an absence point (point_id, question, wanted, normal_question, normal_anchors)."""
    number = F.regexp_extract("point_id", r"(\d+)$", 1)
    numbered = (number != "") & F.regexp_like(segment, F.concat(F.lit(r"(?:^|[\s（(])(?:问题?|第)?\s*"), number, F.lit(r"\s*(?:[)）.、:：]|问)")))
    question = F.col("normal_question")
    topics = reduce(lambda a, b: a | b, (question.contains(t) & normal.contains(t) for t in TOPICS))
    topic = F.when(question.contains("出资"), normal.contains("出资") | normal.contains("投资金额")).when(question.contains("管理人"), normal.contains("管理人")).otherwise(topics)
    anchored = F.exists("normal_anchors", lambda a: (a != "") & normal.contains(a))
    return (coverage(F.col("wanted"), units) >= MENTIONED) | numbered | anchored | topic


def _asked(points: DataFrame, script: Script) -> DataFrame:
    # The anchors are folded as one text and cut again, as the folding is a helper's.
    anchors = F.array_join(F.coalesce("anchors", F.array().cast("array<string>")), "\n")
    lines = F.split(F.coalesce(anchors, F.lit("")), "\n")
    rows = points.select("task", "point_id", "question", scoring_units(F.col("question"), script).alias("wanted"), normal_text(F.col("question"), script).alias("normal_question"), F.explode_outer(lines).alias("anchor"))
    rows = rows.withColumn("normal_anchor", normal_text(F.col("anchor"), script))
    return rows.groupBy("task", "point_id", "question", "wanted", "normal_question").agg(F.collect_set("normal_anchor").alias("normal_anchors"))


def honest_points(answers: DataFrame, points: DataFrame, sources: DataFrame, hints: DataFrame | None = None, script: Script = None) -> DataFrame:
    """(answer_id, point_id, honest, supported, score) for each absence point of an answer's task.

    `points` is (task, point_id, question, anchors), `hints` (task, hint) words
    that explain an absence.  An answer is honest about a point if a segment
    that speaks of it, or a blanket statement, says that nothing is known; it
    is supported by a quote that a source of the task has and that says or
    explains the same.
    """
    asked = _asked(points, script)
    pieces = F.filter(F.transform(F.split("output", r"(?<=[。！？；;])|\n+"), F.trim), lambda x: x != "")
    segments = answers.select("answer_id", "task", F.explode(pieces).alias("segment"))
    segments = segments.select("answer_id", "task", "segment", scoring_units(F.col("segment"), script).alias("units"), normal_text(F.col("segment"), script).alias("normal")).where(F.col("segment").rlike(ABSENCE))
    said = segments.join(asked, "task").where(_speaks_of(F.col("segment"), F.col("units"), F.col("normal"))).select("answer_id", "point_id").distinct().withColumn("said", F.lit(True))
    cited = citations(answers).select("answer_id", "citation").distinct().withColumn("words", normal_text(F.col("citation"), script)).where("words <> ''")
    cited = cited.join(answers.select("answer_id", "task"), "answer_id")
    explains = F.col("citation").rlike(ABSENCE) | F.col("citation").rlike(EXPLAINED)
    if hints is not None:
        words = hints.groupBy("task").agg(F.collect_set(F.lower("hint")).alias("words_of"))
        cited = cited.join(words, "task", "left")
        explains = explains | F.coalesce(F.exists("words_of", lambda h: F.lower("citation").contains(h)), F.lit(False))
    cited = cited.where(explains)
    held = sources.select("task", normal_text(F.col("text"), script).alias("held"))
    found = cited.select("task", "words").distinct().join(held, "task").where(F.col("held").contains(F.col("words"))).select("task", "words").distinct()
    backed = cited.join(found, ["task", "words"]).select("answer_id").distinct().withColumn("backed", F.lit(True))
    out = answers.select("answer_id", "task", F.coalesce(F.col("output").rlike(BLANKET), F.lit(False)).alias("blanket")).join(points.select("task", "point_id"), "task")
    out = out.join(said, ["answer_id", "point_id"], "left").join(backed, "answer_id", "left")
    honest = F.coalesce("said", F.lit(False)) | F.col("blanket")
    supported = honest & F.coalesce("backed", F.lit(False))
    return out.select("answer_id", "point_id", honest.alias("honest"), supported.alias("supported"), F.when(supported, SUPPORTED).when(honest, HONEST).otherwise(0.0).alias("score"))


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.call_function("regexp_extract", text, F.col(pattern), F.lit(k))


def fabricated_entities(answers: DataFrame, known: DataFrame, roles: DataFrame | None = None, script: Script = None) -> DataFrame:
    """(answer_id, role, answer) for each role that an answer gives to someone whom no text of `known` (task, text) names.

    `roles` (task, role) adds to ROLES.
    """
    rows = answers.select("answer_id", "task", without_marks(F.coalesce("output", F.lit(""))).alias("output"))
    named = F.lit("|".join(ROLES))
    if roles is not None:
        more = roles.where("trim(role) <> ''").groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_set("role")), lambda r: F.concat(F.lit(r"\Q"), r, F.lit(r"\E"))), "|").alias("more"))
        rows = rows.join(more, "task", "left")
        named = F.concat_ws("|", named, "more")
    rows = rows.withColumn("roles", named)
    forward = F.concat(F.lit("(?i)("), "roles", F.lit(f"){GIVEN}"))
    backward = F.concat(F.lit(f"(?i){TAKES}("), "roles", F.lit(")"))
    rows = rows.withColumn("forward", forward).withColumn("backward", backward)
    found = rows.withColumn("p", F.explode(F.concat(places(F.col("output"), F.col("forward"), kind="f"), places(F.col("output"), F.col("backward"), kind="b"))))
    match, is_forward = F.col("p.match"), F.col("p.kind") == "f"
    role = F.when(is_forward, _group(match, "forward", 1)).otherwise(_group(match, "backward", 2))
    given = F.when(is_forward, _group(match, "forward", 2)).otherwise(_group(match, "backward", 1))
    given = F.get(F.split(F.trim(F.regexp_replace(given, r"^(?:由)?\s*", "")), r"担任|擔任|出资|承诺|作为|作為|（|\("), F.lit(0))
    found = found.select("answer_id", "task", role.alias("role"), F.regexp_replace(given, "^[ ：:,.，。「」“”\"*_#]+|[ ：:,.，。「」“”\"*_#]+$", "").alias("answer"))
    found = found.where((F.col("answer") != "") & ~F.col("answer").rlike(ABSENCE) & ~F.col("answer").rlike(QUESTION)).distinct()
    found = found.withColumn("words", normal_text(F.col("answer"), script)).where(F.length("words") >= 2)
    held = known.select("task", normal_text(F.col("text"), script).alias("held"))
    real = found.select("task", "words").distinct().join(held, "task").where(F.col("held").contains(F.col("words"))).select("task", "words").distinct()
    return found.join(real, ["task", "words"], "left_anti").select("answer_id", "role", "answer")


def fabricated_amounts(answers: DataFrame, judged: DataFrame, points: DataFrame, script: Script = None) -> DataFrame:
    """(answer_id, answer) for each amount that is not borne out (`judged`, of `fidelity.judge_numbers`) and that answers an absence point.

    Restated questions and units in brackets do not count, nor statements of
    an absence that give no sum.
    """
    wrong = judged.where("kind = 'amount' and verdict in ('unit_mismatch', 'fabricated')").select("answer_id", "raw").distinct()
    rows = answers.select("answer_id", "task", without_marks(F.coalesce("output", F.lit(""))).alias("output")).join(wrong, "answer_id")
    rows = rows.withColumn("p", F.explode(places(F.col("output"), F.concat(F.lit(r"(?i)\Q"), "raw", F.lit(r"\E")))))
    before, match = F.col("p.before"), F.col("p.match")
    after = F.substr("output", F.length(before) + F.length(match) + 1)
    rows = rows.select("answer_id", "task", "raw", before.alias("before"), match.alias("match"), after.alias("after"))
    line = F.concat(F.substring_index("before", "\n", -1), "match", F.substring_index("after", "\n", 1))
    bracket = F.concat(F.regexp_extract("before", r"[（(]([^（）()]*)$", 1), "match", F.regexp_extract("after", r"^([^（）()]*)[)）]", 1))
    bracketed = F.col("before").rlike(r"[（(][^（）()]*$") & F.col("after").rlike(r"^[^（）()]*[)）]")
    rows = rows.where(~is_question(line) & ~(bracketed & is_unit_only(bracket)))
    statement = F.concat(F.regexp_extract("before", r"[^\n。]*$", 0), "match", F.regexp_extract("after", r"^[^\n。]*", 0))
    rows = rows.withColumn("statement", statement)
    paid = F.regexp_like("statement", F.concat(F.lit(f"(?i){PAID}" + r"\Q"), "raw", F.lit(r"\E")))
    rows = rows.where(paid | ~F.col("statement").rlike(ABSENCE)).select("answer_id", "task", "raw", "statement", scoring_units(F.col("statement"), script).alias("units"), normal_text(F.col("statement"), script).alias("normal"))
    spoken = rows.join(_asked(points, script), "task").where(_speaks_of(F.col("statement"), F.col("units"), F.col("normal"))).select("answer_id", "raw")
    free = rows.join(points.select("task").distinct(), "task", "left_anti").select("answer_id", "raw")
    return spoken.unionByName(free).distinct().select("answer_id", F.col("raw").alias("answer"))


def score_absence(answers: DataFrame, honest: DataFrame, entities: DataFrame, amounts: DataFrame) -> DataFrame:
    """(answer_id, n_points, score, n_fabricated, hard_failure): the mean over an answer's points, 1 without any; anything made up is a hard failure."""
    n = honest.groupBy("answer_id").agg(F.count("*").alias("n_points"), F.avg("score").alias("mean"))
    made = entities.select("answer_id").unionByName(amounts.select("answer_id")).groupBy("answer_id").agg(F.count("*").alias("n_fabricated"))
    out = answers.select("answer_id").join(n, "answer_id", "left").join(made, "answer_id", "left").na.fill(0, ["n_points", "n_fabricated"])
    return out.select("answer_id", "n_points", F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("score"), "n_fabricated", (F.col("n_fabricated") > 0).alias("hard_failure"))
