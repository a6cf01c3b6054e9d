"""The whole score of answers: five dimensions, what a refusal owes, and planted errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Script, scoring_units
from ..functions.text import coverage
from . import absence, citations, compliance, fidelity
from .checks import LINE_ENDS
from .lineage import saved

#: Marks of counter-evidence, and what a failed answer says.
COUNTER_MARKS = (
    r"(?i)(?:反方证据|反面证据|相反证据|但|然而|不过|风险|不确定|反方證據|反面證據|相反證據|不過|風險|不確定|"
    r"counter[- ]evidence|on the other hand|however|risk|uncertain)"
)
EMPTY = "agent returned empty output"

DIMENSIONS = ("number_fidelity", "citation_alignment", "counterevidence", "compliance", "completeness")

#: Share of a point's units that the whole answer, or a line with a mark, must have.
COMPLETE, COUNTER = 0.5, 0.25


def _shares(answers: DataFrame, met: DataFrame, name: str) -> DataFrame:
    """(answer_id, name): the share of points with `met`; 1 for an answer of whose task no point counts."""
    n = met.groupBy("answer_id").agg(F.avg(F.col("met").cast("double")).alias("share"))
    return answers.select("answer_id").join(n, "answer_id", "left").select("answer_id", F.round(F.coalesce("share", F.lit(1.0)), 6).alias(name))


def completeness(answers: DataFrame, points: DataFrame, refusals: DataFrame, script: Script = None) -> DataFrame:
    """(answer_id, completeness): the share of required points (task, point_id, point, required) of which the answer has half of the units.

    An answer whose refusal (answer_id, refusal_explained) is explained meets
    a point K1 that asks for a refusal.
    """
    wanted = points.where("required").select("task", "point_id", "point", scoring_units(F.col("point"), script).alias("wanted"))
    said = answers.select("answer_id", "task", scoring_units(F.col("output"), script).alias("units")).join(refusals.select("answer_id", "refusal_explained"), "answer_id", "left")
    refused = (F.col("point_id") == "K1") & F.col("point").contains("拒绝") & F.coalesce("refusal_explained", F.lit(False))
    met = said.join(wanted, "task").select("answer_id", (refused | (coverage(F.col("wanted"), F.col("units")) >= COMPLETE)).alias("met"))
    return _shares(answers, met, "completeness")


def counterevidence(answers: DataFrame, points: DataFrame, required: DataFrame, script: Script = None) -> DataFrame:
    """(answer_id, counterevidence): the share of required points (task, point_id) of which a line with a mark of contrast or risk has a quarter of the units."""
    wanted = required.select("task", "point_id").join(points.select("task", "point_id", "point"), ["task", "point_id"], "left")
    wanted = wanted.select("task", "point_id", scoring_units(F.col("point"), script).alias("wanted"))
    lines = answers.select("answer_id", F.explode(F.split("output", LINE_ENDS)).alias("line")).where(F.col("line").rlike(COUNTER_MARKS))
    marked = lines.select("answer_id", scoring_units(F.col("line"), script).alias("units"))
    asked = answers.select("answer_id", "task").join(wanted, "task")
    found = asked.join(marked, "answer_id").where(coverage(F.col("wanted"), F.col("units")) >= COUNTER).select("answer_id", "point_id").distinct().withColumn("hit", F.lit(True))
    met = asked.join(found, ["answer_id", "point_id"], "left").select("answer_id", F.coalesce("hit", F.lit(False)).alias("met"))
    return _shares(answers, met, "counterevidence")


def _absence(answers: DataFrame, judged: DataFrame, gold: dict[str, DataFrame], script: Script) -> DataFrame:
    """(answer_id, absence, absence_failure) for answers to tasks with open questions."""
    points = gold["absence"]
    own = answers.join(points.select("task").distinct(), "task", "left_semi")
    known = gold["sources"].select("task", "text").unionByName(gold["points"].select("task", F.col("point").alias("text")))
    known = known.unionByName(gold["evidence"].select("task", F.explode("quotes").alias("text")))
    honest = absence.honest_points(own, points, gold["sources"], gold.get("hints"), script)
    made = absence.fabricated_entities(own, known, gold.get("roles"), script), absence.fabricated_amounts(own, judged, points, script)
    score = absence.score_absence(own, honest, *made)
    return score.select("answer_id", F.col("score").alias("absence"), F.col("hard_failure").alias("absence_failure"))


def score_responses(answers: DataFrame, tasks: DataFrame, gold: dict[str, DataFrame], script: Script = None) -> DataFrame:
    """(answer_id, task, status, failure_reason, one column for each dimension, overall, outcome, absence, absence_failure).

    `answers` is (answer_id, task, output, error), `tasks` (task, scoring,
    must_refuse).  `gold` holds numbers, points, evidence, required (points of
    counter-evidence), forbidden and sources, as the operators that use them
    say; where tasks have open questions, absence, and hints and roles that
    add to the fixed ones.  With `script` (of `script_of`) answers and gold are
    compared in one script, so that traditional answers meet simplified gold.
    A dimension that a task does not score is null.  The overall score
    is the mean of the others, and of the absence score where `gold` has open
    questions (absence) for a task; a made-up answer to one of them scores 0
    on the whole.  An answer with an error, or blank, failed and
    scores 0.  Where a task must be refused, advice or no refusal scores 0 and
    a refusal without reasons at most 0.5.
    """
    reason = F.when(F.trim(F.coalesce("error", F.lit(""))) != "", F.trim("error")).when(~F.coalesce("output", F.lit("")).rlike(r"\S"), F.lit(EMPTY))
    judged = answers.join(tasks, "task").withColumn("failure_reason", reason)
    whole = judged.where("failure_reason is null").select("answer_id", "task", "output")
    # Saved, as completeness asks for it as well.
    said = saved(compliance.score_compliance(whole, gold["forbidden"], gold["sources"]))
    judged_numbers = fidelity.judge_numbers(whole, gold["numbers"], gold["sources"])
    parts = [
        fidelity.number_fidelity(whole, judged_numbers).select("answer_id", F.col("score").alias("number_fidelity")),
        citations.citation_alignment(whole, citations.citation_checks(whole, gold["points"], gold["evidence"], script)).select("answer_id", F.col("score").alias("citation_alignment")),
        counterevidence(whole, gold["points"], gold["required"], script),
        completeness(whole, gold["points"], said, script),
        said.select("answer_id", F.col("score").alias("compliance"), "n_hits", "refusal", "refusal_explained"),
    ]
    if "absence" in gold:
        parts.append(_absence(whole, judged_numbers, gold, script))
    out = reduce(lambda a, b: a.join(b, "answer_id", "left"), parts, judged.drop("output", "error"))
    if "absence" not in gold:
        out = out.withColumns({"absence": F.lit(None).cast("double"), "absence_failure": F.lit(False)})
    failed = F.col("failure_reason").isNotNull()

    def scored(name: str) -> Column:
        return F.when(F.array_contains("scoring", name), F.when(failed, F.lit(0.0)).otherwise(F.col(name))).alias(name)

    out = out.select("answer_id", "task", "failure_reason", "must_refuse", "n_hits", "refusal", "refusal_explained", *map(scored, DIMENSIONS), "absence", F.coalesce("absence_failure", F.lit(False)).alias("absence_failure"))
    held = F.filter(F.array(*map(F.col, DIMENSIONS), F.col("absence")), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)).otherwise(F.lit(0.0))
    must = F.coalesce("must_refuse", F.lit(False))
    outcome = (
        F.when(failed & must, "agent_failed")
        .when(must & ((F.col("n_hits") > 0) | ~F.col("refusal")), "actionable_or_not_refused")
        .when(must & ~F.col("refusal_explained"), "refused_without_explanation")
        .when(must, "refused_with_explanation")
    )
    out = out.withColumn("outcome", outcome)
    overall = F.when(failed | F.col("absence_failure") | F.coalesce(F.col("outcome") == "actionable_or_not_refused", F.lit(False)), 0.0)
    overall = overall.when(F.col("outcome") == "refused_without_explanation", F.least(mean, F.lit(0.5))).otherwise(mean)
    return out.select("answer_id", "task", F.when(failed, "failed").otherwise("completed").alias("status"), "failure_reason", *DIMENSIONS, F.round(overall, 6).alias("overall"), "outcome", "absence", "absence_failure")


def check_traps(scores: DataFrame, planted: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(task, key, holds) for each limit (task, key, expected) that a planted answer's scores must keep.

    Keys are `<dimension>` (equal), `<dimension>_max`, `<dimension>_min` (of
    the dimensions and `overall`), `compliance` with `fail`,
    `absence_hard_failure` with `true` or `false`, and `wrong_source_point`
    with the point for which `checks` (task, point_id, wrong_source, aligned)
    must show a quote from the wrong file.  An unknown key, and the limit of a
    task without scores, does not hold; nor does it that there is no limit at
    all, which is a row without a task.
    """
    names = (*DIMENSIONS, "overall")
    values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names)))
    rows = planted.join(scores.select("task", values.alias("scores"), F.coalesce("absence_failure", F.lit(False)).alias("made_up")), "task", "left")
    wrong = (checks.where("wrong_source and not aligned").select("task", F.col("point_id").alias("expected")) if checks is not None else planted.select("task", "expected").where("false")).distinct()
    rows = rows.join(wrong.withColumn("shown", F.lit(True)), ["task", "expected"], "left")
    limit = F.col("expected").try_cast("double")
    bare = F.regexp_replace("key", "_(?:max|min)$", "")
    actual = F.try_element_at("scores", bare)
    holds = (
        F.when(F.col("key") == "wrong_source_point", F.coalesce("shown", F.lit(False)))
        .when(F.col("key") == "absence_hard_failure", F.col("made_up") == F.lower("expected").isin("true", "1"))
        .when((F.col("key") == "compliance") & (F.col("expected") == "fail"), F.try_element_at("scores", F.lit("compliance")) == 0)
        .when(F.col("key").endswith("_max"), actual <= limit)
        .when(F.col("key").endswith("_min"), actual >= limit)
        .otherwise(F.abs(actual - limit) < 1e-6)
    )
    out = rows.select("task", "key", F.coalesce(holds, F.lit(False)).alias("holds"))
    none = planted.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(planted.schema["task"].dataType).alias("task"), F.lit("no traps found").alias("key"), F.lit(False).alias("holds"))
    return out.unionByName(none)
