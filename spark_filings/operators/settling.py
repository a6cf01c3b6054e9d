"""Whether claims state what their questions ask for, in the units that their quotes print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.figures import figures
from ..functions.normal import PATTERN_SCRIPT
from ..functions.questions import asked_kinds, asks_remaining
from .matching import exploded

# Currencies in Latin letters and as filings print them, wording
# that bounds a figure, and questions that ask for the bound.
LATIN_UNIT = r"(?i)(?:cny|rmb|yuan|renminbi|hkd|usd|dollars?|hk\$|us\$|[$¥])"
CJK_UNIT = r"[元股份]|人民币|人民幣|港元|美元"
BOUND = r"(?i)不超过|不超過|不低于|不低於|不高于|不高於|上限|至多|至少|以内|以內|no more than|not exceed|at most|no less than|up to|ceiling|maximum|minimum"
ASKS_BOUND = r"(?i)上限|上限是多少|最高|最多|不超过多少|maximum|upper limit|cap\b|at most|ceiling"
PER_SHARE = r"(?i)每股|/\s*股|per share"
OF_SHARES = r"(?i)股|份|shares?"


def states_kind(found: Column, text: Column, kinds: Column, declared: Column | bool = False) -> Column:
    """Whether a text, with its figures (`figures(text)`), states one of the asked kinds (`asked_kinds`); any digit if none is asked.

    `declared` says that the text's document declares a unit, so that a bare
    figure is an amount.
    """
    declared = declared if isinstance(declared, Column) else F.lit(declared)

    def is_asked(f: Column) -> Column:
        kind = f["kind"]

        def asks(k: str) -> Column:
            return F.array_contains(kinds, k)

        return (
            (asks("percent") & (kind == "percent"))
            | (asks("date") & (kind == "date"))
            | (asks("amount") & ((kind == "amount") | (declared & (kind == "scalar"))))
            | (asks("price") & (f["unit"].contains("/") | ((kind == "amount") & text.rlike(PER_SHARE))))
            | (asks("count") & (kind == "scalar") & text.rlike(OF_SHARES))
            | (asks("doc_no") & (kind == "doc_no"))
        )

    return F.coalesce(F.when(F.size(kinds) == 0, text.rlike("[0-9]")).otherwise(F.exists(found, is_asked)), F.lit(False))


def settled_claims(claims: DataFrame, questions: DataFrame, script: tuple[str, str] = PATTERN_SCRIPT) -> DataFrame:
    """(run, claim_id, question_id, settles): whether each claim states the value that its question asks for.

    `claims` (run, claim_id, question_id, text, unverifiable), `questions`
    (run, question_id, question).  One that is unverifiable does not, nor one
    that only bounds a figure, unless the bound is asked for; any other has to
    state an asked kind.  A question for what is left of an amount also wants an
    amount that no claim of another question of the run states.  A claim of an
    unknown question, or of one that asks for no kind, settles with any digit.
    """
    asked = questions.dropDuplicates(["run", "question_id"]).select("run", "question_id", "question", asked_kinds(F.col("question"), script).alias("_kinds"), asks_remaining(F.col("question"), script).alias("_left"))
    rows = claims.select("run", "claim_id", "question_id", "text", F.coalesce("unverifiable", F.lit(False)).alias("_open"), figures(F.col("text"), script).alias("_a"))
    stated = exploded(rows.select("run", "claim_id", "question_id", "_a"), "_a").where("kind = 'amount'").select("run", "claim_id", "question_id", F.coalesce("numeric_raw", "value").alias("_n")).distinct()
    # An amount is another question's if the first or the last question that states it is another.
    owners = stated.groupBy("run", "_n").agg(F.min("question_id").alias("_first"), F.max("question_id").alias("_last"))
    own = stated.join(owners, ["run", "_n"]).groupBy("run", "claim_id").agg(F.max((F.col("_first") == F.col("question_id")) & (F.col("_last") == F.col("question_id"))).alias("_own"))
    rows = rows.join(asked, ["run", "question_id"], "left").join(own, ["run", "claim_id"], "left")
    kinds = F.coalesce("_kinds", F.array().cast("array<string>"))
    bound = F.col("text").rlike(BOUND) & ~F.coalesce(F.col("question").rlike(ASKS_BOUND), F.lit(False))
    remaining = F.coalesce(F.col("_left"), F.lit(False)) & F.array_contains(kinds, "amount")
    settles = ~F.col("_open") & ~bound & states_kind(F.col("_a"), F.col("text"), kinds) & (~remaining | F.coalesce("_own", F.lit(False)))
    return rows.select("run", "claim_id", "question_id", F.coalesce(settles, F.lit(False)).alias("settles"))


def translated_units(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, written, printed) of claims that write a currency in Latin letters where a quote prints the figure in a Chinese one.

    `claims` (claim_id, text), `evidence` (claim_id, position, quote).  Of
    several the first by the claim's figures, then the quotes' order.  Figures
    meet within a claim by value, or as they are before their multiplier.
    """
    def amounts(df: DataFrame, text: str) -> DataFrame:
        keys = [c for c in df.columns if c != text]
        return exploded(df.select(*keys, figures(F.col(text)).alias("_a")), "_a").where("kind = 'amount'").withColumn("_key", F.explode(F.array(F.concat(F.lit("v"), "value"), F.concat(F.lit("r"), "numeric_raw"))))

    written = amounts(claims.select("claim_id", "text"), "text").where(F.col("raw").rlike(LATIN_UNIT) & ~F.col("raw").rlike(CJK_UNIT)).select("claim_id", "_key", F.col("place").alias("_place"), F.trim("raw").alias("_written"))
    printed = amounts(evidence.select("claim_id", "position", "quote"), "quote").where(F.col("raw").rlike(CJK_UNIT))
    first = printed.groupBy("claim_id", "_key").agg(F.min(F.struct("position", "place", F.trim("raw").alias("raw"))).alias("_p"))
    met = written.join(first, ["claim_id", "_key"]).groupBy("claim_id").agg(F.min(F.struct("_place", "_p", "_written")).alias("_m"))
    return met.select("claim_id", F.col("_m._written").alias("written"), F.col("_m._p.raw").alias("printed"))
