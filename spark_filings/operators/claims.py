"""Plans, gaps, counter-evidence and audits of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_plan(plan: DataFrame, catalog: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, document_id, whole): planned documents that exist.

    A question without any reads the whole catalogue: it has one row with
    `whole` true and no document, rather than a row for each document.
    """
    known = plan.join(catalog.select("document_id").distinct(), "document_id", "left_semi").select("question_id", "document_id").distinct()
    asked = questions.select("question_id").distinct()
    return asked.join(known, "question_id", "left").withColumn("whole", F.col("document_id").isNull())


def close_gaps(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """(question_id, status): answered, gap (no claim), or residual (its only claims say that nothing is found)."""
    told = claims.groupBy("question_id").agg(F.max((~F.col("absence")).cast("int")).alias("told"))
    out = questions.select("question_id").distinct().join(told, "question_id", "left")
    return out.select("question_id", F.when(F.col("told").isNull(), "gap").when(F.col("told") == 1, "answered").otherwise("residual").alias("status"))


def withdrawn(claims: DataFrame) -> DataFrame:
    """Absence claims on questions that another claim answers, unless they are residual."""
    answered = claims.where("not absence").select("question_id").distinct()
    return claims.where("absence and not residual").join(answered, "question_id", "left_semi")


def resolve_counter_evidence(claims: DataFrame, located: DataFrame) -> DataFrame:
    """(claim_id, status): filled with located counter quotes, downgraded to a sound fallback, or dropped."""
    found = located.groupBy("claim_id").agg(F.count("*").alias("n"))
    out = claims.where("type = 'model_inference'").join(found, "claim_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "filled").when(F.col("fallback_ok"), "downgraded").otherwise("dropped")
    return out.select("claim_id", status.alias("status"))


def verify_locators(verdicts: DataFrame, memos: DataFrame, longest: int = 60) -> DataFrame:
    """Add `checked`: a verdict stays only with a verbatim locator in the memo's body.

    `not_addressed` needs none.  Locators of more than `longest` characters,
    and those that only the preamble has, do not count.
    """
    met = verdicts.join(memos, "memo_id", "left")
    sound = (F.length("locator") > 0) & (F.length("locator") <= longest) & F.contains("body", "locator")
    keep = (F.col("verdict") == "not_addressed") | F.coalesce(sound, F.lit(False))
    return met.select(*verdicts.columns, F.when(keep, F.col("verdict")).otherwise("unverified").alias("checked"))
