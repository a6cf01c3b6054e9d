"""Quality rules: a learned decision list over counts of each text.

The counts are plain Spark expressions over the whole text.  Sequential
covering learns an ordered list of threshold conjunctions from statistics of
labelled documents: each rule is grown on one part of the labelled rows by
information gain, pruned on the other part and kept if it is precise enough
there; the rows it covers are then removed.  The list becomes one Spark
conditional expression, which gives each document's verdict.

Everything that touches documents is DataFrame operations.  What the driver
sees is a table of statistics, a row for each distinct vector of threshold
indices among at most `max_labelled` labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, column, saved, table

#: Symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

#: At most so many labelled rows, the first by a hash of their id, train the list.
MAX_LABELLED = 20_000

#: Ratios that conditions of the list test: name -> (numerator, denominator) columns.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "words": ("n_words", None),
}
BINS = 24

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks", "n_digits"]


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in `words`.

    Windows are sorted by a hash with the position in the low bits, so that
    repeated ones become neighbours; the windows themselves then confirm it.
    All steps are linear or sort a row's own array.
    """

    def windows(w: Column) -> Column:
        last = F.size(w) - 3

        def packed(bits: Column) -> Column:
            high = F.shiftleft(F.lit(-1).cast("long"), 1) if isinstance(bits, int) else F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
            keys = F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
            )
            return _let(F.sort_array(keys), lambda s: _neighbours(s, high))

        def _neighbours(s: Column, high: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce(x.bitwiseXOR(y).bitwiseAND(high) == 0, F.lit(False))

            near = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | ((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0))))))
            return F.transform(near, lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int"))

        bits = F.ceil(F.log2(F.greatest(F.size(w), F.lit(2)) + 1)).cast("int")
        return F.when(last < 1, F.array().cast("array<int>")).otherwise(packed(bits))

    def confirmed(w: Column, near: Column) -> Column:
        exact = F.sort_array(F.transform(near, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("g"), i.alias("i"))))

        def twins(s: Column) -> Column:
            kept = F.filter(
                s,
                lambda x, k: F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False))
                | ((k > 0) & (x["g"] == F.get(s, F.greatest(k - 1, F.lit(0)))["g"])),
            )
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        return _let(exact, twins)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(
        words,
        lambda w: _let(windows(w), lambda near: F.when(F.size(near) == 0, F.lit(0).cast("long")).otherwise(_let(confirmed(w, near), covered))),
    )


def text_counts(text: Column) -> dict[str, Column]:
    """Expressions of the counts; the column `_words` must hold `words_of(text)`."""
    whole = F.coalesce(text, F.lit(""))

    def of(pattern: str) -> Column:
        return F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": of(SPACE),
        "n_symbols": of(r"[^#*$%&|<>]+"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(F.col("_words")),
        "n_upper": of(r"[^\p{Lu}]+"),
        "n_marks": of(r"[^!?]+"),
        "n_digits": of(r"[^0-9]+"),
    }


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, counts): a row for each document."""
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    return rows.select("_id", *(c.alias(n) for n, c in text_counts(F.col("_text")).items()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") if under is None else F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1))


@dataclass
class Rule:
    """A conjunction of (ratio, is_above, threshold) that rejects, with its labelled figures."""

    conditions: list[tuple[str, bool, float]]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, edge in self.conditions:
            out = out & (ratio(name) > edge if above else ratio(name) <= edge)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {e:.4g}" for n, a, e in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The number of the first rule that fires, or null: an ordered conditional expression."""
        out = None
        for k, rule in enumerate(self.rules):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(None).cast("int") if out is None else out


def _chosen(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """(_lid, _y): at most `max_labelled` labelled ids, the first by a hash."""
    return (
        labels.select(column(id_col).alias("_lid"), column(label_col).cast("int").alias("_y"))
        .where(F.col("_lid").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_lid")
        .agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
        .where("_y = _z")
        .select("_lid", "_y")
        .orderBy(F.xxhash64("_lid"), "_lid")
        .limit(max_labelled)
    )


def learn_decision_list(
    counts: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    min_precision: float = 0.9,
    min_covered: int = 5,
    max_conditions: int = 3,
    max_rules: int = 12,
) -> DecisionList:
    """Learn which documents to reject (label 0) from labelled ones.

    Labels that are null, that contradict each other for one id, or whose
    document is missing are ignored.  Without labelled rows of both kinds the
    list is empty.  The statistics are gathered by Spark: thresholds are
    quantiles over the labelled rows, and rows are counted by vector of
    threshold indices, label and part (grow or prune).
    """
    chosen = _chosen(labels, id_col, label_col, max_labelled)
    usable = counts.where(~base_failed()).select("_id", *(ratio(n).alias(n) for n in RATIOS))
    rows = saved(usable.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_y", (F.pmod(F.xxhash64("_lid", F.lit(1)), F.lit(3)) == 0).alias("_prune"), *RATIOS))
    names = list(RATIOS)
    cuts = rows.agg(*(F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 10_000).alias(n) for n in names)).first()
    if cuts is None or cuts[0] is None:
        return DecisionList()
    edges = {n: sorted(set(cuts[n])) for n in names}

    def index(n: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[n])), lambda e: F.col(n) > e)).cast("int").alias(n)

    cells = rows.select("_y", "_prune", *map(index, names)).groupBy("_y", "_prune", *names).count().collect()
    x = np.array([[r[n] for n in names] for r in cells], dtype=np.int32).reshape(-1, len(names))
    y = np.array([r["_y"] for r in cells])
    prune = np.array([r["_prune"] for r in cells])
    weight = np.array([r["count"] for r in cells], dtype=np.int64)
    order = np.lexsort((prune, y, *x.T))
    return _cover(x[order], y[order] == 0, prune[order], weight[order], names, edges, min_precision, min_covered, max_conditions, max_rules)


def _cover(x, bad, prune, weight, names, edges, min_precision, min_covered, max_conditions, max_rules) -> DecisionList:
    """Sequential covering over weighted cells of threshold indices."""
    found = DecisionList()
    left = np.ones(len(bad), dtype=bool)
    tests = [(f, above, k) for f, n in enumerate(names) for k in range(len(edges[n])) for above in (True, False)]

    def fires(test) -> np.ndarray:
        f, above, k = test
        return x[:, f] > k if above else x[:, f] <= k

    def figures(mask) -> tuple[int, int]:
        return int(weight[mask & bad].sum()), int(weight[mask & ~bad].sum())

    def precision(mask) -> float:
        p, n = figures(mask)
        return (p + 0.5) / (p + n + 1)

    while len(found.rules) < max_rules and figures(left & ~prune)[0]:
        at, rule = left & ~prune, []
        p, n = figures(at)
        while n and len(rule) < max_conditions:
            gains = []
            for test in tests:
                p1, n1 = figures(at & fires(test))
                gains.append((p1 * (math.log2((p1 + 1e-9) / (p1 + n1 + 1e-9)) - math.log2(p / (p + n))) if p1 else 0.0, -p1 - n1, test))
            most = max(gains)[0]
            if most <= 1e-9:
                break
            # Of tests that gain about as much, the one that covers least stays clear of good rows.
            best = max((g[1:] for g in gains if g[0] >= 0.97 * most))[1]
            rule.append(best)
            at = at & fires(best)
            p, n = figures(at)
        # Prune: drop final conditions while that does not lower the precision on the other part.
        judge = left & prune if figures(left & prune)[0] >= min_covered else left
        whole = lambda tests, of: np.logical_and.reduce([of, *map(fires, tests)])
        while len(rule) > 1 and precision(whole(rule[:-1], judge)) >= precision(whole(rule, judge)):
            rule.pop()
        if not rule:
            break
        covers = whole(rule, left)
        p, n = figures(covers)
        if p < min_covered or p < min_precision * (p + n) or precision(whole(rule, judge)) < min_precision - 0.1:
            break
        found.rules.append(Rule([(names[f], above, float(edges[names[f]][k])) for f, above, k in rule], p + n, p / (p + n)))
        left &= ~covers
    return found


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Return (id_col, counts, base_failed, rule, kept), a row for each document.

    A null text has no words and so fails the base rule.  A null id keeps its
    row.  Repeated rows are judged alike; of conditions that tie, the one named
    first wins.  Very long texts are counted whole.  Other columns are ignored.  An
    empty table, or one without labels, learns no rule.
    """
    counts = saved(with_counts(docs, id_col, text_col))
    rules = learn_decision_list(counts, labels, id_col, **learning)
    return (
        counts.withColumn("base_failed", base_failed())
        .withColumn("rule", F.when(~F.col("base_failed"), rules.column()))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
        .withColumnRenamed("_id", id_col)
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    The same conditional expression is applied to each row in place, so rows
    are neither joined nor reordered.
    """
    # Of all texts only those that may train are counted for training; the others stay where they are.
    chosen = saved(_chosen(labels, id_col, learning.get("label_col", "quality"), learning.get("max_labelled", MAX_LABELLED)).select("_lid"))
    some = docs.select(column(id_col).alias(id_col), column(text_col).alias(text_col))
    some = some.join(F.broadcast(chosen), column(id_col) == F.col("_lid"), "left_semi")
    rules = learn_decision_list(saved(with_counts(some, id_col, text_col)), labels, id_col, **learning)
    names = docs.columns
    rows = docs.select(F.struct(*map(column, names)).alias("_row"), column(text_col).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    rows = rows.select("_row", *(c.alias(n) for n, c in text_counts(F.col("_text")).items()))
    return rows.where(~base_failed() & rules.column().isNull()).select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
