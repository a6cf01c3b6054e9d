"""Figures of claims bound to what justifies them, and whole texts swept for figures that no source has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.figures import FIGURE, HINT, figures, unit_hints
from .matching import exploded, is_year, offers, wants


def _hints(df: DataFrame) -> Column:
    none = F.array().cast(f"array<{HINT}>")
    return F.coalesce("hints", none) if "hints" in df.columns else none


def bind_numbers(claims: DataFrame, evidence: DataFrame, derived: DataFrame | None = None, years: bool = True) -> DataFrame:
    """(claim_id, place, raw, kind, value, unit, provenance, source_id, unit_from, state): a row for each figure of each claim.

    `claims` (claim_id, text); `evidence` (claim_id, evidence_id, position,
    quote and, if there are any, hints of the quote's document); `derived`
    (claim_id, derived_id, position, display).  A figure that a derivation of
    the claim prints is derived; else the first of the claim's own quotes that
    justifies it binds it (verbatim, by the first printed figure that does);
    a bare year is weak, anything else unbound (state).  unit_from is the
    declaration that gave a bare figure its unit.  Without `years` no figure
    is a year, for texts that state only sums.

    All rules are keys of one join within a claim: candidates are ranked by
    source, position, place and rule, and the least is taken by an aggregate.
    Null texts and quotes have no figures; repeated evidence changes nothing.
    """
    stated = exploded(claims.select("claim_id", figures(F.col("text")).alias("_a")), "_a").drop("start", "end")
    printed = exploded(evidence.select("claim_id", F.lit(1).alias("_of"), "position", F.col("evidence_id").alias("_id"), _hints(evidence).alias("_hints"), figures(F.col("quote")).alias("_a")), "_a")
    offered = printed.select("claim_id", "_of", "position", "_id", "place", F.explode(offers(F.col("_hints"))).alias("_k"))
    if derived is not None:
        none = F.array().cast(f"array<{HINT}>")
        own = exploded(derived.select("claim_id", F.lit(0).alias("_of"), "position", F.col("derived_id").alias("_id"), figures(F.col("display")).alias("_a")), "_a")
        offered = offered.unionByName(own.select("claim_id", "_of", "position", "_id", "place", F.explode(offers(none)).alias("_k")))
    best = offered.select("claim_id", F.col("_k.key").alias("_key"), F.struct("_of", "position", F.col("place").alias("_at"), F.col("_k.rule").alias("_rule"), F.col("_id").alias("_source"), F.col("_k.source").alias("_unit_from")).alias("_hit"))
    best = best.groupBy("claim_id", "_key").agg(F.min("_hit").alias("_hit"))
    wanted = stated.withColumn("_w", F.explode(wants())).select("*", F.col("_w.key").alias("_key")).drop("_w")
    names = ["claim_id", "place", "raw", "kind", "value", "unit"]
    hits = wanted.join(best, ["claim_id", "_key"], "left").groupBy(*names).agg(F.min("_hit").alias("_hit"))
    bound = F.col("_hit").isNotNull()
    return hits.select(
        *names,
        F.when(bound, F.when(F.col("_hit._of") == 0, "derived").otherwise("verbatim")).alias("provenance"),
        F.col("_hit._source").alias("source_id"),
        F.col("_hit._unit_from").alias("unit_from"),
        F.when(bound, "bound").when(is_year() & F.lit(years), "weak").otherwise("unbound").alias("state"),
    )


def verify_numbers(texts: DataFrame, sources: DataFrame, allowed: DataFrame | None = None, years: bool = True) -> DataFrame:
    """(run, text_id, place, raw, kind, value, unit, verdict, severity, nearest): each figure of each text against its run's sources.

    `texts` (run, text_id, text), `sources` (run, document_id, text) and
    `allowed` (run, display), figures that were computed.  A figure is
    `verified` if a source justifies it, under the units that this source
    itself declares; else `unit_mismatch` (high) if a source or computed
    amount prints the same figure in another unit or scale, with one such in
    `nearest`; else a bare year is `unsupported_year` (low), and anything else
    `not_in_source` (high).  Without `years` no figure is a year, for texts
    that state only sums.

    Sources are reduced to the distinct keys of a run before they meet a text,
    so a figure that every document prints is one row.  Null texts have no
    figures.
    """
    stated = exploded(texts.select("run", "text_id", figures(F.col("text")).alias("_a")), "_a").drop("start", "end")
    printed = exploded(sources.select("run", unit_hints(F.col("text")).alias("_hints"), figures(F.col("text")).alias("_a")), "_a")
    if allowed is not None:
        none = F.array().cast(f"array<{HINT}>")
        printed = printed.unionByName(exploded(allowed.select("run", none.alias("_hints"), figures(F.col("display")).alias("_a")), "_a"))
    # Justifications and near misses are keys of the same join.
    kind = F.col("kind") == "amount"
    near = F.array_compact(F.array(F.when(kind, F.concat_ws("\x1f", F.lit("figure"), "numeric_raw")), F.when(kind, F.concat_ws("\x1f", F.lit("value"), "value"))))
    form = F.struct("unit", "multiplier")
    just = printed.select("run", F.explode(offers(F.col("_hints"))).alias("_k")).select("run", F.col("_k.key").alias("_key"), F.lit(None).cast("struct<unit:string,multiplier:string>").alias("_form"), F.lit(None).cast("string").alias("_raw"))
    misses = printed.select("run", F.explode(near).alias("_key"), form.alias("_form"), F.col("raw").alias("_raw"))
    known = just.unionByName(misses).groupBy("run", "_key", "_form").agg(F.min("_raw").alias("_raw"))
    # A key has few forms: units and multipliers.
    known = known.groupBy("run", "_key").agg(F.collect_set(F.struct("_form", "_raw")).alias("_forms"))
    wanted = stated.withColumn("_key", F.explode(F.concat(F.transform(wants(), lambda w: w["key"]), near)))
    met = wanted.join(known, ["run", "_key"], "left")
    names = ["run", "text_id", "place", "raw", "kind", "value", "unit"]
    is_near = F.col("_key").startswith("figure\x1f") | F.col("_key").startswith("value\x1f")
    # Of an equal figure the unit or scale must differ, of an equal value the unit.
    other = F.filter("_forms", lambda x: (x["_form"]["unit"] != F.col("unit")) | (F.col("_key").startswith("figure") & (x["_form"]["multiplier"] != F.col("multiplier"))))
    met = met.withColumn("_near", F.when(is_near, F.array_min(F.transform(other, lambda x: x["_raw"]))))
    out = met.groupBy(*names).agg(F.max(F.col("_forms").isNotNull() & ~is_near).alias("_held"), F.min("_near").alias("_near"))
    verdict = F.when(F.col("_held"), "verified").when(F.col("_near").isNotNull(), "unit_mismatch").when(is_year() & F.lit(years), "unsupported_year").otherwise("not_in_source")
    out = out.select(*names, verdict.alias("verdict"), "_near")
    severity = F.when(F.col("verdict") == "unsupported_year", "low").when(F.col("verdict") != "verified", "high")
    return out.select(*names, "verdict", severity.alias("severity"), F.when(F.col("verdict") == "unit_mismatch", F.col("_near")).alias("nearest"))


def sweep(verified: DataFrame) -> DataFrame:
    """(run, text_id, n_figures, n_high, n_low, ok) of texts that state figures: ok says that no violation is high."""
    def count(level: str) -> Column:
        return F.count(F.when(F.col("severity") == level, 1))

    return verified.groupBy("run", "text_id").agg(F.count("*").alias("n_figures"), count("high").alias("n_high"), count("low").alias("n_low"), (count("high") == 0).alias("ok"))
