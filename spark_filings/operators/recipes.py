"""Recipes for requests, their coverage by claims, and questions that repeat each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage, semantic_units
from .lineage import saved

#: Units too common to make a text be about something.
GENERIC = (
    "公司",
    "本次",
    "是否",
    "多少",
    "哪家",
    "什么",
    "什麼",
    "披露",
    "揭露",
    "公告",
    "是谁",
    "是誰",
    "机构",
    "機構",
    "情况",
    "情況",
    "有关",
    "有關",
    "相关",
    "相關",
    "进行",
    "進行",
    "以及",
    "关于",
    "關於",
    "是多",
    "的是",
    "the",
    "of",
    "is",
    "are",
    "what",
    "which",
    "company",
)

#: Share of a checklist item's, and of a derivation's, units that claims must have.
COVERED, DERIVED = 0.4, 0.5


def key_units(text: Column) -> Column:
    """Units that tell what a text is about."""
    return F.array_except(semantic_units(text), F.array(*map(F.lit, GENERIC)))


def select_recipe(requests: DataFrame, recipes: DataFrame) -> DataFrame:
    """(request_id, recipe_id, selection, score) for requests (request_id, question, title, asked_id).

    A recipe (id, question_keywords, doc_keywords, fallback) scores two for
    each keyword that the question has and one for each that the title has,
    and needs one in the question, as titles cannot be trusted.  The best
    wins, of equals the first by id.  A recipe that is asked for by its id
    goes before all, one that does not exist gives no row, and the fallback
    comes last.  Recipes are few and broadcast.
    """

    def hits(keywords: str, text: str) -> Column:
        return F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.coalesce(F.col(text), F.lit("")).contains(k)))

    rows = requests.crossJoin(F.broadcast(recipes))
    rows = rows.withColumn("in_question", hits("question_keywords", "question")).withColumn("score", 2 * F.col("in_question") + hits("doc_keywords", "title"))
    fallback = F.coalesce("fallback", F.lit(False))
    selection = F.when(F.col("asked_id").isNotNull(), F.when(F.col("asked_id") == F.col("id"), "explicit")).when(fallback, "fallback").when(F.col("in_question") > 0, "matched")
    rows = rows.withColumn("selection", selection).where("selection is not null").withColumn("score", F.when(F.col("selection") == "matched", F.col("score")).otherwise(0))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("selection") == "fallback", F.desc("score"), "id"))
    return rows.withColumn("place", place).where("place = 1").select("request_id", F.col("id").alias("recipe_id"), "selection", F.col("score").cast("long").alias("score"))


def recipe_coverage(items: DataFrame, claims: DataFrame) -> DataFrame:
    """(run, item_id, share, covered): how much of each checklist item (run, item_id, item, kind) the run's claims (run, claim, is_gap) have.

    An item is covered by COVERED of its distinctive units, one of the kind
    `derivation` by DERIVED of them in one claim.  Gap claims count for nothing.
    """
    held = claims.where(~F.coalesce("is_gap", F.lit(False))).select("run", semantic_units(F.col("claim")).alias("units"))
    wanted = items.select("run", "item_id", "kind", key_units(F.col("item")).alias("wanted"))
    # Units of a run meet items by (run, unit); for derivations claims stay apart.
    together = held.select("run", F.explode("units").alias("unit")).distinct()
    asked = wanted.select("run", "item_id", "kind", F.size("wanted").alias("n"), F.explode_outer("wanted").alias("unit"))
    found = asked.where("kind <> 'derivation'").join(together, ["run", "unit"]).groupBy("run", "item_id").agg(F.count("*").alias("k"))
    apart = held.withColumn("claim_no", F.monotonically_increasing_id()).select("run", "claim_no", F.explode("units").alias("unit"))
    single = asked.where("kind = 'derivation'").join(apart, ["run", "unit"]).groupBy("run", "item_id", "claim_no").count().groupBy("run", "item_id").agg(F.max("count").alias("k"))
    out = wanted.join(found.unionByName(single), ["run", "item_id"], "left")
    share = F.when(F.size("wanted") == 0, F.lit(1.0)).otherwise(F.coalesce("k", F.lit(0)) / F.size("wanted"))
    least = F.when(F.col("kind") == "derivation", DERIVED).otherwise(COVERED)
    return out.select("run", "item_id", F.round(share, 6).alias("share"), (share >= least).alias("covered"))


def missing_questions(questions: DataFrame, asked: DataFrame, least: float = 0.6, shortest: int = 4) -> DataFrame:
    """Recipe questions (run, question_id, question) to ask after all: those asked (run, text) do not cover each of their clauses.

    Clauses end at question marks and semicolons and have `shortest`
    characters; a question without such a clause is one itself.  A clause is
    covered if one question that is asked has the share `least` of its units.
    """
    parts = F.filter(F.transform(F.split("question", r"[?？;；]+"), F.trim), lambda x: F.length(x) >= shortest)
    clauses = questions.select("run", "question_id", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array("question"))).alias("clause"))
    clauses = clauses.select("run", "question_id", "clause", semantic_units(F.col("clause")).alias("wanted")).distinct()
    held = asked.select("run", semantic_units(F.col("text")).alias("units"))
    met = clauses.join(held, "run").where(coverage(F.col("wanted"), F.col("units")) >= least).select("run", "question_id", "clause").distinct()
    open_ones = clauses.join(met, ["run", "question_id", "clause"], "left_anti").select("run", "question_id").distinct()
    return questions.join(open_ones, ["run", "question_id"], "left_semi")


#: Share of each other's units from which two questions ask the same.
SAME = 0.75


def dedupe_questions(questions: DataFrame) -> DataFrame:
    """(run, question_id, kept_id): each question (run, question_id, position, text) with the one that is kept for it, itself or an earlier one.

    In the order of positions a question is kept, unless it and an earlier kept
    one have SAME of each other's units; then it merges into the first such.
    Questions without units are the same question.

    Questions with equal units share their fate and are one row; others meet
    by the rarest of their units, of which two that are the same have one in
    common.  The order is worked off in rounds: a question is decided when all
    earlier ones that it meets are, or when one of them is kept; rounds are as
    many as the longest chain of undecided ones.
    """
    units = semantic_units(F.col("text"))
    rows = questions.select("run", "question_id", "position", F.when(F.size(units) == 0, F.array(F.lit(""))).otherwise(F.array_sort(units)).alias("units"))
    rows = saved(rows)
    firsts = saved(rows.groupBy("run", "units").agg(F.min(F.struct("position", "question_id")).alias("node")))
    terms = firsts.select("run", "node", "units", F.explode("units").alias("unit"))
    n = terms.groupBy("run", "unit").agg(F.count("*").alias("n"))
    rarity = F.row_number().over(Window.partitionBy("run", "node").orderBy("n", "unit"))
    rare = terms.join(n, ["run", "unit"]).withColumn("_r", rarity).where(F.col("_r") <= F.size("units") - F.ceil(F.size("units") * SAME) + 1)
    later, earlier = rare.select("run", "unit", "node", "units"), rare.select("run", "unit", F.col("node").alias("before"), F.col("units").alias("units_before"))
    met = later.join(earlier, ["run", "unit"]).where(F.col("before") < F.col("node"))
    mutual = (coverage(F.col("units"), F.col("units_before")) >= SAME) & (coverage(F.col("units_before"), F.col("units")) >= SAME)
    edges = saved(met.where(mutual).select("run", "node", "before").distinct())
    state = saved(firsts.join(edges.select("run", "node").distinct(), ["run", "node"], "left_anti").select("run", "node", F.lit(True).alias("kept")))
    while True:
        known = edges.join(state.select("run", F.col("node").alias("before"), F.col("kept").alias("_k")), ["run", "before"], "left")
        judged = known.join(state.select("run", "node"), ["run", "node"], "left_anti").groupBy("run", "node").agg(F.max(F.coalesce("_k", F.lit(False))).alias("_any"), F.max(F.col("_k").isNull()).alias("_open"))
        new = saved(judged.where("_any or not _open").select("run", "node", (~F.col("_any")).alias("kept")))
        if new.isEmpty():
            break
        state = saved(state.unionByName(new))
    kept = state.where("kept").select("run", F.col("node").alias("before"))
    into = edges.join(kept, ["run", "before"]).groupBy("run", "node").agg(F.min("before").alias("_into"))
    fate = firsts.join(into, ["run", "node"], "left").select("run", "units", F.coalesce("_into", "node").getField("question_id").alias("kept_id"))
    return rows.join(fate, ["run", "units"]).select("run", "question_id", "kept_id")
