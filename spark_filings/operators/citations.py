"""Quotes that answers cite, what they claim with them, and whether the gold evidence bears it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Script, normal_text, overlap, scoring_units
from ..functions.places import places, without_marks
from ..functions.text import coverage, fold_width

# How quotes are set off, how files and sources are named, and
# words whose directions exclude each other.
QUOTED = (
    "「([^「」]+)」",
    "『([^『』]+)』",
    "“([^“”]+)”",
    '"([^"\n]{4,})"',
    r"(?iU)(?:出处原句|出处|原文|source|evidence|quote)\s*[:：]\s*(?![“「『\"])([^\n。；;\]]+)",
    r"(?mU)^>\s*(.+)$",
)
LABEL = r"(?iU)(?:[-*\s]*\[?\s*)?(?:出处原句|出处|原文|source|evidence|quote)\s*[:：]?\s*$"
LEAD = r"(?U)^[-*\s]*(?:公告)?(?:明确|指出|称)[:：\s]*$"
CONTEXT_FILE = r"(?:\.{0,2}[/\\])?context[/\\][A-Za-z0-9_.-]+\.txt"
SOURCE_FILE = (
    rf"(?iU){CONTEXT_FILE}|(?:source[_\s-]*file|来源文件|來源檔案|出处文件|出處檔案)\s*[:=：]\s*[“”「」『』\"']?([A-Za-z0-9_.\\/-]+\.txt)|[A-Za-z0-9_-]+\.txt"
)
SIGIL = r"\b([A-Z][A-Za-z0-9]{0,3}-[A-Z0-9]{1,4})\b"
CONFLICTS = (
    (r"(?i)(?:尚未|未曾|没有|沒有|not yet|has not|have not)", r"(?i)(?:已(?:经|經)?进入|已(?:经|經)?受理|已获批准|已獲批准|has entered|was accepted|has been accepted)"),
    (r"(?i)(?:不确定|不確定|uncertain|uncertainty)", r"(?i)(?:肯定|必然|确定会|確定會|一定会|一定會|definitely|certain to|will surely)"),
)

#: Overlap from which a citation is the evidence, and what makes a citation speak of a point.
ALIGNED = 0.45
OPTIONAL = 0.45
CLAIM_COVERAGE, SHARED_UNITS, CITATION_COVERAGE = 0.25, 3, 0.3


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def file_name(text: Column) -> Column:
    """A source file in one form: half width, lower case, forward slashes, no leading `./`."""
    return F.regexp_replace(F.lower(F.replace(_trim(fold_width(text)), F.lit("\\"), F.lit("/"))), r"^(?:\./)+", "")


def _file_of(match: Column) -> Column:
    inner = F.regexp_extract(match, SOURCE_FILE, 1)
    raw = F.when(inner != "", inner).otherwise(match)
    path = F.regexp_extract(raw, f"(?i){CONTEXT_FILE}", 0)
    return file_name(F.when(path != "", path).otherwise(raw))


def _legend(output: Column) -> Column:
    """Files by sigil from lines that name both, first ones first."""
    named = rf"(?i){CONTEXT_FILE}|[A-Za-z0-9_-]+\.txt"
    lines = F.filter(F.split(output, "\n"), lambda x: x.rlike(SIGIL) & x.rlike(named))
    return F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(SIGIL), F.lit(1)), lambda s: F.struct(s.alias("sigil"), file_name(F.regexp_extract(x, named, 0)).alias("file")))))


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, claim, citation, source_file), distinct, for each quote in answers (answer_id, output).

    The claim is what stands before a quote in its line, or with nothing there
    the nearest earlier line and that.  The source file is the nearest one
    named in the line, the one before or the one after, by its name or by a
    sigil that another line gives to a file; empty if there is none.
    """
    texts = answers.select("answer_id", without_marks(F.coalesce("output", F.lit(""))).alias("output"))
    found = F.concat(*(places(F.col("output"), p, kind=str(k)) for k, p in enumerate(QUOTED)))
    rows = texts.withColumn("legend", _legend(F.col("output"))).withColumn("p", F.explode(found)).select("answer_id", "output", "legend", "p.*")
    quote = reduce(lambda out, k: out.when(F.col("kind") == str(k), F.regexp_extract("match", QUOTED[k], 1)), range(1, len(QUOTED)), F.when(F.col("kind") == "0", F.regexp_extract("match", QUOTED[0], 1)))
    rows = rows.withColumn("citation", _trim(quote)).where("citation <> ''")
    lines = F.split("before", "\n")
    rows = rows.select(
        "answer_id",
        "citation",
        "legend",
        F.length("match").alias("size"),
        F.element_at(lines, -1).alias("head"),
        # Whole lines before; the last one does not count if the quote begins its line.
        F.slice(lines, F.lit(1), F.greatest(F.size(lines) - F.when(F.element_at(lines, -1) == "", 2).otherwise(1), F.lit(0))).alias("earlier"),
        F.when(F.size(lines) > 1, F.element_at(lines, -2)).alias("previous"),
        F.concat(F.element_at(lines, -1), "match", F.substring_index(F.substr("output", F.length("before") + F.length("match") + 1), "\n", 1)).alias("line"),
        F.get(F.split(F.substr("output", F.length("before") + F.length("match") + 1), "\n"), F.lit(1)).alias("next"),
    )
    own = _trim(F.regexp_replace(_trim(F.col("head")), LABEL, ""))
    rows = rows.withColumn("own", own)
    solid = F.filter(F.transform("earlier", _trim), lambda x: (x != "") & (x != "---") & ~x.rlike(r"^[-*\s]+$"))
    speaks = (F.size(scoring_units(F.col("own"))) > 0) & ~F.col("own").rlike(LEAD)
    claim = F.when(speaks | (F.size(solid) == 0), F.col("own")).otherwise(_trim(F.concat_ws(" ", F.element_at(solid, -1), "own")))

    def named(segment: Column, shift: Column, order: int) -> Column:
        """Files named in a segment whose start lies `shift` before the quote: (distance, order, place, file)."""

        def candidate(kind: int, file: Column, p: Column) -> Column:
            at = F.length(p["before"]) - shift
            return F.struct(F.least(F.abs(at), F.abs(at - F.col("size"))).alias("distance"), F.lit(order + kind).alias("order"), at.alias("at"), file.alias("file"))

        files = F.transform(places(segment, SOURCE_FILE), lambda p: candidate(0, _file_of(p["match"]), p))
        known = F.filter(places(segment, SIGIL), lambda p: F.exists("legend", lambda x: x["sigil"] == p["match"]))
        sigils = F.transform(known, lambda p: candidate(3, F.get(F.filter("legend", lambda x: x["sigil"] == p["match"]), F.lit(0))["file"], p))
        return F.concat(files, sigils)

    head = F.length("head")
    near = F.array_min(
        F.concat(
            named(F.col("line"), head, 0),
            named(F.concat_ws("\n", F.coalesce("previous", F.lit("")), "line"), head + 1 + F.length(F.coalesce("previous", F.lit(""))), 1),
            named(F.concat(F.lit("\n"), F.coalesce("next", F.lit(""))), head - F.length("line"), 2),
        )
    )
    rows = rows.select("answer_id", claim.alias("claim"), "citation", near.alias("near"))
    return rows.select("answer_id", "claim", "citation", F.coalesce("near.file", F.lit("")).alias("source_file")).distinct()


def _conflicts(gold: Column, output: Column) -> Column:
    return reduce(lambda a, b: a | b, (gold.rlike(a) & output.rlike(b) for a, b in CONFLICTS))


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def citation_checks(answers: DataFrame, points: DataFrame, evidence: DataFrame, script: Script = None) -> DataFrame:
    """(answer_id, task, evidence_id, point_id, best_overlap, best_with_source, conflict, aligned, wrong_source) for each piece of evidence that applies.

    `points` is (task, point_id, point, required), `evidence` (task,
    evidence_id, point_id, quotes, source_file) with the quotes in the
    author's order.  Evidence applies if its point is required, or if the
    answer (answer_id, task, output) makes the point.  It is borne if a
    citation that speaks of the point overlaps one of the quotes, from the
    file that is asked for, and the answer does not say the contrary.
    """
    wanted = evidence.join(points, ["task", "point_id"], "left").select(
        "task", "evidence_id", "point_id", "quotes", F.coalesce("point", F.lit("")).alias("point"), F.coalesce("required", F.lit(True)).alias("required"), file_name(F.coalesce("source_file", F.lit(""))).alias("wanted_file")
    ).withColumn("wanted", scoring_units(F.col("point"), script))
    said = answers.select("answer_id", "task", "output", scoring_units(F.col("output"), script).alias("units"))
    asked = said.join(wanted, "task").where(F.col("required") | (coverage(F.col("wanted"), F.col("units")) >= OPTIONAL)).drop("units")
    records = citations(answers).select("answer_id", "citation", "source_file", scoring_units(F.col("claim"), script).alias("claim_units"), scoring_units(F.col("citation"), script).alias("cited_units"), normal_text(F.col("citation"), script).alias("cited"))
    pairs = asked.select("answer_id", "evidence_id", "quotes", "wanted", "wanted_file").join(records, "answer_id")
    eligible = (
        (coverage(F.col("wanted"), F.col("claim_units")) >= CLAIM_COVERAGE)
        | (F.size(F.array_intersect("wanted", "claim_units")) >= SHARED_UNITS)
        | (coverage(F.col("wanted"), F.col("cited_units")) >= CITATION_COVERAGE)
    )
    pairs = pairs.where(eligible).select("answer_id", "evidence_id", "wanted_file", "source_file", "cited", F.posexplode("quotes").alias("quote_no", "quote"))
    pairs = pairs.withColumn("overlap", overlap(normal_text(F.col("quote"), script), F.col("cited")))
    fits = (F.col("wanted_file") == "") | ((F.col("source_file") != "") & (_base(F.col("source_file")) == _base(F.col("wanted_file"))))
    by_quote = pairs.groupBy("answer_id", "evidence_id", "quote_no").agg(F.max("overlap").alias("best"), F.coalesce(F.max(F.when(fits, F.col("overlap"))), F.lit(0.0)).alias("sourced"))
    best = by_quote.groupBy("answer_id", "evidence_id").agg(F.max("best").alias("best_overlap"), F.max(F.struct("sourced", (-F.col("quote_no")).alias("m"))).alias("top"))
    out = asked.join(best, ["answer_id", "evidence_id"], "left")
    quote_no, sourced = F.coalesce(-F.col("top.m"), F.lit(0)), F.coalesce("top.sourced", F.lit(0.0))
    conflict = _conflicts(F.concat_ws(" ", "point", F.get("quotes", quote_no)), F.col("output"))
    met = F.coalesce("best_overlap", F.lit(0.0))
    return out.select(
        "answer_id",
        "task",
        "evidence_id",
        "point_id",
        F.round(met, 6).alias("best_overlap"),
        F.round(sourced, 6).alias("best_with_source"),
        conflict.alias("conflict"),
        ((sourced >= ALIGNED) & ~conflict).alias("aligned"),
        ((F.col("wanted_file") != "") & (met >= ALIGNED) & (sourced < ALIGNED)).alias("wrong_source"),
    )


def citation_alignment(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """(answer_id, n_checks, n_aligned, score): the share of evidence that is borne, at most 0.5 with a conflict, 1 without any."""
    n = checks.groupBy("answer_id").agg(F.count("*").alias("n_checks"), F.count(F.when(F.col("aligned"), 1)).alias("n_aligned"), F.max("conflict").alias("any"))
    out = answers.select("answer_id").join(n, "answer_id", "left").na.fill(0, ["n_checks", "n_aligned"])
    share = F.when(F.col("n_checks") > 0, F.col("n_aligned") / F.col("n_checks")).otherwise(F.lit(1.0))
    return out.select("answer_id", "n_checks", "n_aligned", F.round(F.when(F.coalesce("any", F.lit(False)), F.least(share, F.lit(0.5))).otherwise(share), 6).alias("score"))
