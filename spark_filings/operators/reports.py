"""Reports over scores, claims and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_report(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, lang, n, mean): means by dimension and language, and over either or both.

    A null in place of a dimension or language stands for all of them.
    Dimensions that a score lacks (null) count for nothing.
    """
    long = scores.select("lang", F.explode(F.map_from_arrays(F.array(*map(F.lit, dimensions)), F.array(*(F.col(d).cast("double") for d in dimensions)))).alias("dimension", "value")).where("value is not null")
    return long.cube("dimension", "lang").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def compare_runs(scores: DataFrame, agents: list[str]) -> DataFrame:
    """(lang, one mean for each of two agents, delta, spread over runs)."""
    runs = scores.where(F.col("agent").isin(agents)).groupBy("lang", "agent", "run").agg(F.avg("overall").alias("mean"))
    both = runs.groupBy("lang").pivot("agent", agents).agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.max("mean") - F.min("mean"), 6).alias("spread"))
    a, b = agents
    return both.select("lang", F.col(f"{a}_mean").alias("first_mean"), F.col(f"{b}_mean").alias("second_mean"), F.round(F.col(f"{a}_mean") - F.col(f"{b}_mean"), 6).alias("delta"), F.col(f"{a}_spread").alias("first_spread"), F.col(f"{b}_spread").alias("second_spread"))


def intern_evidence(spans: DataFrame, run: str, keys: list[str], order: list[str]) -> DataFrame:
    """One id E1, E2, ... for each distinct span of a run, in the order first seen."""
    first = spans.groupBy(run, *keys).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(run).orderBy("_first", *keys)))).drop("_first")


def merge_rounds(first: DataFrame, second: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Claims of two rounds, of those with equal trimmed text the first."""
    rows = first.withColumn("_round", F.lit(0)).unionByName(second.withColumn("_round", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(run, F.trim("text")).orderBy("_round", *order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "_round")


def risk_claims(claims: DataFrame, run: str, pattern: str, k: int = 3) -> DataFrame:
    """A run's claims with most matches of a pattern, at most k, ties by claim id."""
    counted = claims.withColumn("n_risk", F.regexp_count(F.lower("text"), F.lit(pattern)).cast("long")).where("n_risk > 0")
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("n_risk"), "claim_id"))).where(F.col("place") <= k)
