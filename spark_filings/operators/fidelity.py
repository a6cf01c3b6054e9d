"""How far the figures of answers are those of the gold and of the sources, by joins on values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import declared_units, explode_numbers, normal_document, shift_point

#: Gold units for which the stated value and unit hold, whatever the figure in the text says.
STATED_UNITS = ("CNY", "USD", "HKD", "date", "doc_no", "percent")

#: A derived gold value is met within this relative distance.
TOLERANCE = 0.005 + 1e-9

#: Width of the logarithmic bins by which values meet those within TOLERANCE.
_BIN = 0.02


def _keyed(tokens: DataFrame) -> DataFrame:
    """Add (k_unit, k_value), equal for figures that state one quantity: percents count as ratios."""
    percent = F.col("unit") == "percent"
    return tokens.withColumn("k_unit", F.when(percent, F.lit("ratio")).otherwise(F.col("unit"))).withColumn(
        "k_value", F.when(percent, shift_point(F.col("value"), F.lit(-2))).when(F.col("unit") == "doc_no", normal_document(F.col("value"))).otherwise(F.col("value"))
    )


def gold_tokens(gold: DataFrame) -> DataFrame:
    """Gold items (task, gold_id, verbatim, value, unit, derived) as figures.

    The first figure of the verbatim text stands for an item; a derived item,
    and one of the STATED_UNITS, has its stated value and unit instead.
    Without a figure in the text the item is its stated value and unit.
    """
    read = explode_numbers(gold.select("gold_id", "task", "verbatim"), "verbatim")
    first = read.groupBy("task", "gold_id").agg(F.min_by(F.struct("kind", "value", "unit", "numeric_raw", "power"), "place").alias("p"))
    rows = gold.select("task", "gold_id", "value", "unit", F.coalesce("derived", F.lit(False)).alias("derived")).join(first, ["task", "gold_id"], "left")
    stated = F.col("p").isNull() | F.col("derived") | F.col("unit").isin(*STATED_UNITS)
    value = F.when(F.col("unit") == "doc_no", normal_document(F.col("value"))).otherwise(F.col("value"))
    return rows.select(
        "task",
        "gold_id",
        "derived",
        F.when(F.col("p").isNull(), F.col("unit")).otherwise(F.col("p.kind")).alias("kind"),
        F.when(stated, value).otherwise(F.col("p.value")).alias("value"),
        F.when(stated, F.col("unit")).otherwise(F.col("p.unit")).alias("unit"),
        "p.numeric_raw",
        "p.power",
    )


def _bins(value: Column) -> Column:
    return F.floor(F.log(F.abs(value)) / F.lit(_BIN))


def _key(of: str, *parts: Column) -> Column:
    """A key of a kind, null if a part is: q a quantity, y a year, f the figure of an amount, v its value, n a bin of like values."""
    return F.concat(F.lit(of), *(F.concat(F.lit("\x1f"), p.cast("string")) for p in parts))


def _near_key(as_ratio: Column, value: Column, bin_of: Column) -> Column:
    return _key("n", as_ratio, F.when(value == 0, "zero").otherwise(bin_of.cast("string")))


#: What a fact says of a figure that has its key, the first one that any says.
_GOLD, _SOURCE, _DECLARED, _YEAR = range(4)


def _facts(gold: DataFrame, sources: DataFrame, derived: bool) -> DataFrame:
    """(task, key, rank, lo, hi, goals): what gold figures and the sources (task, text) of a task say of a key.

    For f and v, lo and hi are the least and greatest (unit, power) of amounts; for n, goals are derived values.
    """
    form = "struct<unit:string,power:int>"

    def fact(key: Column, rank: int | None = None, unit: Column | None = None, power: Column | None = None) -> Column:
        pair = F.lit(None).cast(form) if unit is None else F.struct(unit.alias("unit"), F.lit(None).cast("int").alias("power") if power is None else power.alias("power")).cast(form)
        return F.when(key.isNotNull(), F.struct(key.alias("key"), F.lit(rank).cast("int").alias("rank"), pair.alias("pair")))

    amount, kind, value, unit = F.col("kind") == "amount", F.col("kind"), F.col("value"), F.col("unit")
    quantity = _key("q", F.col("k_unit"), F.col("k_value"))
    forms = [fact(F.when(amount, _key("f", F.col("numeric_raw"))), None, unit, F.col("power")), fact(F.when(amount & unit.isNotNull(), _key("v", value)), None, unit)]
    years = fact(F.when(kind == "date", _key("y", F.substring("value", 1, 4))).when((kind == "scalar") & _is_year(), _key("y", value)), _YEAR)

    def rows(tokens: DataFrame, *facts: Column) -> DataFrame:
        return tokens.select("task", F.explode(F.array_compact(F.array(*facts))).alias("_f")).select("task", "_f.*")

    # Distinct, so that a long source costs its text once; both uses below read one shuffle, as none puts a filter under it.
    held = _keyed(explode_numbers(sources, "text").drop("place", "raw").distinct())
    bare = held.select("task", F.explode(F.when(kind == "scalar", F.array(value))).alias("value")).distinct()
    tables = bare.join(declared_units(sources, "text").distinct(), "task").select("task", "unit", shift_point(value, F.col("power")).alias("value"))
    wanted = _keyed(gold)
    out = rows(wanted, fact(quantity, _GOLD), *forms).unionByName(rows(held, fact(quantity, _SOURCE), years, *forms)).unionByName(rows(tables, fact(_key("q", unit, value), _DECLARED)))
    goals = F.lit(None).cast("array<double>").alias("goals")
    if derived:
        # Within the tolerance lie values of a bin or of its neighbours; 0 meets only 0.
        goal = wanted.where("derived").select("task", value.try_cast("double").alias("goal"), (unit == "ratio").alias("as_ratio")).where("goal is not null")
        bins = F.when(F.col("goal") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.sequence(_bins(F.col("goal")) - 1, _bins(F.col("goal")) + 1))
        goal = goal.withColumn("bin", F.explode(bins)).select("task", _near_key(F.col("as_ratio"), F.col("goal"), F.col("bin")).alias("key"), "goal")
        out = out.unionByName(goal.where("key is not null"), allowMissingColumns=True)
        goals = F.collect_set("goal").alias("goals")
    return out.groupBy("task", "key").agg(F.min("rank").alias("rank"), F.min("pair").alias("lo"), F.max("pair").alias("hi"), goals)


def _is_year() -> Column:
    return F.col("value").rlike(r"^(?:19[0-9][0-9]|20[0-9][0-9]|2100)$")


def judge_numbers(answers: DataFrame, gold: DataFrame, sources: DataFrame) -> DataFrame:
    """Each figure of the answers (answer_id, task, output) with its `verdict`.

    In this order: `gold` (a gold figure of the task, or near a derived one),
    `source` (a figure of the task's sources), `declared` (a bare figure of
    the sources in a unit that they declare for their tables), `source_year`
    or `unlisted_year` (a bare year), `unit_mismatch` (a gold or source figure
    in another unit), `fabricated`.

    `gold` is as in `gold_tokens`; `sources` has (task, text).  Gold and
    sources are reduced to facts, one for each key of a task; a figure asks
    for its few keys, so everything meets in one join, and each text is read
    once.
    """
    derived = not gold.where("derived").isEmpty()
    facts = _facts(gold_tokens(gold), sources.select("task", "text"), derived)
    tokens = _keyed(explode_numbers(answers.select("answer_id", "task", "output"), "output"))
    kind, value, unit = F.col("kind"), F.col("value"), F.col("unit")
    amount, is_year = kind == "amount", (kind == "scalar") & _is_year()
    asked = [(_key("q", F.col("k_unit"), F.col("k_value")), None), (F.when(is_year, _key("y", value)), None), (F.when(amount, _key("f", F.col("numeric_raw"))), None), (F.when(amount, _key("v", value)), None)]
    if derived:
        # Units are not compared, but a percent meets a ratio as a ratio.
        own = value.try_cast("double")
        ratio = F.when(unit == "percent", own / 100).otherwise(own)
        asked += [(_near_key(F.lit(as_ratio), x, F.when(x != 0, _bins(x))), x) for as_ratio, x in ((False, own), (True, ratio))]
    asked = F.array_compact(F.array(*(F.when(k.isNotNull(), F.struct(k.alias("key"), (F.lit(None).cast("double") if x is None else x).alias("as_number"))) for k, x in asked)))
    names = ["answer_id", "task", "place", "raw", "kind", "value", "unit"]
    pair = F.struct("unit", "power")
    rows = tokens.select(*names, pair.alias("pair"), asked.alias("_asked"))
    rows = rows.select(*names, "pair", F.size("_asked").alias("n_asked"), F.explode(F.array_compact("_asked")).alias("_a")).select(*names, "pair", "n_asked", "_a.*")
    met = rows.join(facts, ["task", "key"], "left")
    a, of = F.col("as_number"), F.substring("key", 1, 1)
    near = F.exists("goals", lambda b: F.when(b == 0, a == 0).otherwise(F.abs(a - b) / F.abs(b) <= TOLERANCE))
    rank = F.when((of == "n") & near, _GOLD).otherwise(F.col("rank"))

    def differs(bound: str) -> Column:
        return F.coalesce(F.when(of == "f", F.col(bound) != F.col("pair")).when(of == "v", F.col(f"{bound}.unit") != unit), F.lit(False))

    # Another unit exists if the least or the greatest of those known is another.
    out = met.groupBy(*names).agg(F.min(rank).alias("rank"), F.max(differs("lo") | differs("hi")).alias("other"), (F.count("*") / F.min("n_asked")).cast("int").alias("times"))
    verdict = (
        F.when(F.col("rank") == _GOLD, "gold")
        .when(F.col("rank") == _SOURCE, "source")
        .when(F.col("rank") == _DECLARED, "declared")
        .when(is_year & (F.col("rank") == _YEAR), "source_year")
        .when(is_year, "unlisted_year")
        .when(amount & F.col("other"), "unit_mismatch")
        .otherwise("fabricated")
    )
    # Answers that are given twice keep their rows.
    return out.select(*names, F.explode(F.array_repeat(verdict, F.col("times"))).alias("verdict"))


def number_fidelity(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """(answer_id, n_valid, n_mismatch, n_fabricated, n_years, score) for each answer.

    The score is valid / (valid + 2 mismatches + fabricated), less 0.1 for
    each distinct year that is not listed, at most 0.5 with a mismatch and 1
    without any figure.
    """

    def n(*verdicts: str) -> Column:
        return F.count(F.when(F.col("verdict").isin(*verdicts), 1))

    counts = judged.groupBy("answer_id").agg(
        n("gold", "source", "declared", "source_year").alias("n_valid"),
        n("unit_mismatch").alias("n_mismatch"),
        n("fabricated").alias("n_fabricated"),
        F.countDistinct(F.when(F.col("verdict") == "unlisted_year", F.col("value"))).alias("n_years"),
    )
    out = answers.select("answer_id").join(counts, "answer_id", "left").na.fill(0)
    weighed = F.col("n_valid") + 2 * F.col("n_mismatch") + F.col("n_fabricated")
    score = F.greatest(F.when(weighed > 0, F.col("n_valid") / weighed).otherwise(F.lit(1.0)) - 0.1 * F.col("n_years"), F.lit(0.0))
    return out.withColumn("score", F.round(F.when(F.col("n_mismatch") > 0, F.least(score, F.lit(0.5))).otherwise(score), 6))
