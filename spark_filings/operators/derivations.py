"""Calculations that a model proposes, done by the pipeline: operands found in evidence, exact results with intervals.

Proposals depend on each other.  They are solved level by level: a level is a
join of what is pending with what is settled, and as no chain may be deeper
than DEEPEST, few levels settle all that can succeed.  What is left then is on
a cycle or behind one, or behind a chain that is too deep; cycles are told
apart by taking away what nothing pending leads to, or what leads nowhere.

Arithmetic is exact, on fractions, in one small helper per level: a printed
figure stands for an interval of half a unit of its last place to both sides,
sums add half-widths, products and quotients take the four corners.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.figures import HINT, decimal_text, figures
from ..functions.text import letter_id
from .lineage import saved
from .matching import exploded, offers, wants

DEEPEST = 3

# How unit prices print, and the digits that quotients keep.
PRICES = {"CNY": "元/股", "USD": "USD/share", "HKD": "港元/股"}
CURRENCIES = ("CNY", "USD", "HKD")
QUOTIENT_DIGITS, CORNER_DIGITS = 10, 12

SYMBOLS = {"sum": " + ", "difference": " - ", "product": " × ", "quotient": " / ", "ratio": " / "}

_SOLVED = T.StructType([T.StructField(c, T.StringType()) for c in ("value", "unit", "display", "tolerance", "uncertainty", "reason")])


class Rejected(ValueError):
    """A calculation that has no right result; the message is the reason."""


def rounded(x: Fraction, digits: int) -> Fraction:
    """Half away from zero."""
    whole = (2 * abs(x.numerator) * 10**digits + x.denominator) // (2 * x.denominator)
    return Fraction(whole if x >= 0 else -whole, 10**digits)


def fixed(x: Fraction, digits: int) -> str:
    """With so many decimals."""
    cents = int(abs(rounded(x, digits)) * 10**digits)
    text = str(cents).zfill(digits + 1)
    text = text[: len(text) - digits] + ("." + text[-digits:] if digits else "")
    return ("-" if x < 0 and cents else "") + text


class Quantity:
    """A value, half the width of its interval, and its dimension: money to a power, counts to a power, and a currency."""

    def __init__(self, value: Fraction, half: Fraction, money: int, counts: int, currency: str | None) -> None:
        self.value, self.half, self.money, self.counts, self.currency = value, half, money, counts, currency

    @classmethod
    def of(cls, value: str, half: str, unit: str) -> Quantity:
        x, h = Fraction(value), Fraction(half)
        if unit in CURRENCIES:
            return cls(x, h, 1, 0, unit)
        if unit.endswith("/unit"):
            return cls(x, h, 1, -1, unit.removesuffix("/unit"))
        if unit == "scalar":
            return cls(x, h, 0, 1, None)
        if unit in ("percent", "ratio", "multiple"):
            return cls(x, h, 0, 0, None)
        raise Rejected(f"operand unit '{unit}' is not something to calculate with")

    def factor(self, unit: str) -> Quantity:
        """A percentage is a hundredth of what stands before its sign."""
        if unit != "percent":
            return self
        value, half = (rounded(x / 100, CORNER_DIGITS) for x in (self.value, self.half))
        return Quantity(value, half, self.money, self.counts, self.currency)

    @property
    def ends(self) -> tuple[Fraction, Fraction]:
        return self.value - self.half, self.value + self.half

    def joined(self, other: Quantity, sign: int) -> Quantity:
        """Nothing of the dimension that a product (1) or quotient (-1) with another has."""
        if self.currency and other.currency and self.currency != other.currency:
            raise Rejected(f"cannot {'multiply' if sign > 0 else 'divide'} {self.dimension} by {other.dimension}")
        money = self.money + sign * other.money
        return Quantity(Fraction(0), Fraction(0), money, self.counts + sign * other.counts, (self.currency or other.currency) if money else None)

    def spanning(self, value: Fraction, corners: list[Fraction]) -> Quantity:
        """This dimension, with a value and the interval about it that has all corners."""
        self.value, self.half = value, max(abs(value - min(corners)), abs(max(corners) - value))
        return self

    def times(self, other: Quantity) -> Quantity:
        return self.joined(other, 1).spanning(self.value * other.value, [a * b for a in self.ends for b in other.ends])

    def over(self, other: Quantity, op: str, units: list[str]) -> Quantity:
        out = self.joined(other, -1)
        out.unit(op, units)
        low, high = other.ends
        if low <= 0 <= high:
            raise Rejected("divisor interval spans zero at the precision it was printed; the quotient is unbounded")
        corners = [rounded(a / b, CORNER_DIGITS) for a in self.ends for b in other.ends]
        return out.spanning(rounded(self.value / other.value, QUOTIENT_DIGITS), corners)

    @property
    def dimension(self) -> str:
        parts = [f"{self.currency or 'money'}^{self.money}"] if self.money else []
        return "·".join(parts + ([f"count^{self.counts}"] if self.counts else [])) or "dimensionless"

    def unit(self, op: str, units: list[str]) -> str:
        """The unit of a product or quotient."""
        match (self.money, self.counts):
            case (0, 0):
                shares = all(u in ("percent", "ratio") for u in units)
                return "ratio" if op == "ratio" or shares else "multiple"
            case (0, 1):
                return "scalar"
            case (1, 0) if self.currency:
                return self.currency
            case (1, -1) if self.currency:
                return f"{self.currency}/unit"
        raise Rejected(f"{'product' if op == 'product' else 'quotient'} has no representable dimension ({self.dimension})")


def calculate(op: str, operands: list[dict]) -> tuple[Fraction, Fraction, str]:
    """Value, half-width and unit of an operation on (value, half, unit); Rejected with the reason if there is none."""
    units = [o["unit"] for o in operands]
    terms = [Quantity.of(o["value"], o["half"], o["unit"]) for o in operands]
    if op in ("sum", "difference"):
        if len(set(units)) > 1:
            raise Rejected(f"{op} needs operands in one unit, got {', '.join(units)}")
        sign = 1 if op == "sum" else -1
        return terms[0].value + sign * sum(t.value for t in terms[1:]), sum(t.half for t in terms), units[0]
    terms = [t.factor(u) for t, u in zip(terms, units)]
    if op == "product":
        out = terms[0]
        for t in terms[1:]:
            out = out.times(t)
    elif op in ("quotient", "ratio"):
        if len(terms) != 2:
            raise Rejected(f"{op} takes exactly two operands")
        out = terms[0].over(terms[1], op, units)
    else:
        raise Rejected(f"unknown operation '{op}'")
    return out.value, out.half, out.unit(op, units)


def shown(value: Fraction, unit: str, digits: int) -> str:
    """As a reader sees it: shares as percentages, unit prices and multiples with their unit, amounts plain."""
    if unit == "ratio":
        return fixed(value * 100, digits) + "%"
    if unit.endswith("/unit"):
        currency = unit.removesuffix("/unit")
        return f"{fixed(value, digits)} {PRICES.get(currency, currency)}"
    return fixed(value, digits) + {"multiple": "倍", "percent": "%"}.get(unit, "")


@F.pandas_udf(_SOLVED)
def _solved(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    # Values may have more digits than Spark's decimals.
    def solve(op: str, operands, digits: int) -> tuple:
        try:
            value, half, unit = calculate(op, list(operands))
        except Rejected as e:
            return (None, None, None, None, None, str(e))
        relative = rounded(half / abs(value), CORNER_DIGITS) if value else Fraction(0)
        return decimal_text(value), unit, shown(value, unit, digits), decimal_text(relative), decimal_text(half), None

    for ops, operands, digits in parts:
        yield pd.DataFrame([solve(*row) for row in zip(ops, operands, digits)], columns=_SOLVED.names)


def locate_operands(operands: DataFrame, evidence: DataFrame) -> DataFrame:
    """`operands` (run, proposal_id, place, display, evidence_id) with value, half, unit, raw, found_in and reason.

    `evidence` (run, evidence_id, position, document_id, quote and, if there
    are any, hints).  The first figure of an operand is looked for in the quote
    that it names, then in the other quotes of the same document in their
    order, and never in another document; one that names no known evidence is
    looked for in all quotes of its run.  A bare operand takes the printed
    figure with its unit.  found_in is where it is, raw as it is printed there,
    and half is half a unit of the last place printed.

    A run's quotes meet its operands by the keys of their figures, and the best
    hit is an aggregate.  Repeated evidence rows change nothing.
    """
    none = F.array().cast(f"array<{HINT}>")
    hints = F.coalesce("hints", none) if "hints" in evidence.columns else none
    asked = operands.select("run", "proposal_id", "place", F.trim(F.coalesce("display", F.lit(""))).alias("_display"), F.col("evidence_id").alias("_named"))
    where = evidence.select("run", F.col("evidence_id").alias("_named"), F.col("document_id").alias("_document")).groupBy("run", "_named").agg(F.min("_document").alias("_document"))
    # Read once for both that look for its figure and for what becomes of it.
    asked = saved(asked.join(where, ["run", "_named"], "left").withColumn("_f", F.get(figures(F.col("_display")), F.lit(0))))
    printed = exploded(evidence.select("run", "evidence_id", "position", F.col("document_id").alias("_of"), hints.alias("_hints"), figures(F.col("quote")).alias("_a")), "_a", ["run", "evidence_id", "position", "_of", "_hints"])

    def scope(of: str, name: Column) -> Column:
        return F.concat(F.lit(of), name)

    # A figure offers its keys within its quote, its document and its run; the first of each is one row for a lookup.
    offered = printed.select(
        "run", "evidence_id", "position", "_of", F.col("place").alias("_at"), F.struct("raw", "kind", "value", "unit", "multiplier").alias("_hit"), F.explode(offers(F.col("_hints"))).alias("_k")
    )
    scopes = F.array_compact(F.array(scope("q", F.col("evidence_id")), scope("d", F.col("_of")), F.lit("r")))
    offered = offered.select("run", F.explode(scopes).alias("_scope"), F.col("_k.key").alias("_key"), F.struct("position", "_at", F.col("_k.rule").alias("_rule"), "evidence_id", "_hit").alias("_where"))
    offered = offered.groupBy("run", "_scope", "_key").agg(F.min("_where").alias("_where"))
    known = F.col("_document").isNotNull()
    wider = F.struct(F.lit(1).alias("rank"), F.when(known, scope("d", F.col("_document"))).otherwise("r").alias("scope"))
    asking = F.when(known, F.array(F.struct(F.lit(0).alias("rank"), scope("q", F.col("_named")).alias("scope")), wider)).otherwise(F.array(wider))
    keyed = asked.where("_f is not null").select("run", "proposal_id", "place", "_named", "_document", "_f.*").withColumn("_key", F.explode(F.transform(wants(), lambda w: w["key"])))
    keyed = keyed.select("run", "proposal_id", "place", "_key", F.explode(asking).alias("_s")).select("run", "proposal_id", "place", "_key", F.col("_s.rank").alias("_rank"), F.col("_s.scope").alias("_scope"))
    best = keyed.join(offered, ["run", "_scope", "_key"]).groupBy("run", "proposal_id", "place").agg(F.min(F.struct("_rank", "_where")).alias("_best"))
    out = asked.join(best, ["run", "proposal_id", "place"], "left")
    hit, wanted = F.col("_best._where._hit"), F.col("_f")
    bare = (wanted["kind"] == "scalar") & (hit["kind"] != "scalar")

    def taken(field: str) -> Column:
        return F.when(bare, hit[field]).otherwise(wanted[field])

    numeric = ~taken("kind").isin("date", "doc_no")
    raw = taken("raw")
    # Half a unit of the last place: a 5 one place further, times the multiplier.
    places = F.length(F.regexp_extract(F.regexp_replace(raw, r"[\s,]", ""), r"\.([0-9]+)", 1))
    multiplier = F.coalesce(taken("multiplier"), F.lit("1"))
    zeros = F.length(multiplier) - 1
    half = F.when(places + 1 > zeros, F.concat(F.lit("0."), F.repeat(F.lit("0"), places - zeros), F.lit("5"))).otherwise(F.concat(F.lit("5"), F.repeat(F.lit("0"), zeros - places - 1)))
    quoted = F.concat(F.lit("operand '"), "_display", F.lit("'"))
    reason = (
        F.when(wanted.isNull(), F.concat(quoted, F.lit(" contains no number")))
        .when(hit.isNull() & F.col("_document").isNotNull(), F.concat(quoted, F.lit(" does not occur in any quote from evidence '"), "_named", F.lit("'’s document")))
        .when(hit.isNull(), F.concat(quoted, F.lit(" cites unknown evidence '"), F.coalesce("_named", F.lit("")), F.lit("' and occurs in no cited quote")))
        .when(~numeric, F.concat(quoted, F.lit(" is not numeric")))
    )
    out = out.select("run", "proposal_id", "place", taken("value").alias("value"), half.alias("half"), taken("unit").alias("unit"), F.trim(raw).alias("raw"), F.col("_best._where.evidence_id").alias("found_in"), reason.alias("reason"))
    found = F.col("reason").isNull()
    return out.select("run", "proposal_id", "place", *(F.when(found, F.col(c)).alias(c) for c in ("value", "half", "unit", "raw", "found_in")), "reason")


def _edges(pending: DataFrame) -> DataFrame:
    """(run, proposal_id, derived_id) between pending proposals."""
    wanted = pending.select("run", "proposal_id", F.explode("operands").alias("_o")).where("_o.derived_id is not null").select("run", "proposal_id", F.col("_o.derived_id").alias("derived_id")).distinct()
    return wanted.join(pending.select("run", F.col("proposal_id").alias("derived_id")), ["run", "derived_id"], "left_semi")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(run, proposal_id) of what leads back to itself over `edges` (run, proposal_id, derived_id).

    Ends of paths are taken away until none is left, which leaves cycles and
    what is between them; from those, paths are followed until they return or
    end.  Rounds are as many as the longest path; the pairs are those of the
    cycles alone.
    """
    edges = saved(edges.select("run", "proposal_id", "derived_id").distinct())
    size = edges.count()
    while size:
        inner = edges.join(edges.select("run", F.col("proposal_id").alias("derived_id")).distinct(), ["run", "derived_id"], "left_semi")
        inner = inner.join(edges.select("run", F.col("derived_id").alias("proposal_id")).distinct(), ["run", "proposal_id"], "left_semi")
        inner = saved(inner.select("run", "proposal_id", "derived_id"))
        left = inner.count()
        edges = inner
        if left == size:
            break
        size = left
    reached = edges.select("run", "proposal_id", F.col("derived_id").alias("_at"))
    front = reached
    step = edges.select("run", F.col("proposal_id").alias("_at"), F.col("derived_id").alias("_next"))
    while size:
        on = front.where("proposal_id <> _at").join(step, ["run", "_at"]).select("run", "proposal_id", F.col("_next").alias("_at")).distinct()
        front = saved(on.join(reached, ["run", "proposal_id", "_at"], "left_anti"))
        size = front.count()
        reached = saved(reached.unionByName(front)) if size else reached
    return reached.where("proposal_id = _at").select("run", "proposal_id").distinct()


def compute_derivations(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run, proposal_id, derived_id, value, unit, display, formula, tolerance, uncertainty, depends_on, depth, found_in, reason): a row for each proposal.

    `proposals` (run, proposal_id, position, op, precision, operands): position
    numbers the proposals of a run from 0 and names them (D-A, D-B, ...), op is
    sum, difference, product, quotient or ratio, precision (null: 2) the
    decimals shown, operands an array of (display, evidence_id, derived_id): a
    figure to be found in evidence, or another proposal of the run.
    `evidence` is as for `locate_operands`.

    A proposal without a result has null in all but its ids and the reason: it
    is on a cycle, has fewer than two operands, its first operand that fails,
    a chain deeper than DEEPEST, mixed units, a dimension without a unit, or a
    divisor whose interval spans zero.  Proposal ids are distinct within a run;
    of repeated ones the first by position counts.
    """
    proposals = proposals.withColumn("_n", F.row_number().over(Window.partitionBy("run", "proposal_id").orderBy("position"))).where("_n = 1").drop("_n")
    # Saved, as every level asks for it again.
    numbered = saved(proposals.select("run", "proposal_id", "position", "op", F.coalesce("precision", F.lit(2)).alias("precision"), F.coalesce("operands", F.array().cast(proposals.schema["operands"].dataType)).alias("operands")))
    terms = numbered.select("run", "proposal_id", F.posexplode("operands").alias("place", "_o")).select("run", "proposal_id", "place", "_o.*")
    leaves = locate_operands(terms.where("derived_id is null"), evidence)
    leaves = saved(leaves.select("run", "proposal_id", "place", F.lit(1).alias("depth"), "value", "half", "unit", F.col("raw").alias("shown"), "found_in", "reason"))
    links = terms.where("derived_id is not null").select("run", "proposal_id", "place", "derived_id")
    # An operand that no proposal of the run defines fails at once.
    known = links.join(numbered.select("run", F.col("proposal_id").alias("derived_id")), ["run", "derived_id"], "left_semi")
    unknown = links.join(numbered.select("run", F.col("proposal_id").alias("derived_id")), ["run", "derived_id"], "left_anti")
    null = F.lit(None).cast("string")
    failed_links = unknown.select("run", "proposal_id", "place", F.lit(1).alias("depth"), *(null.alias(c) for c in ("value", "half", "unit", "shown", "found_in")), F.concat(F.lit("operand references unknown derivation '"), "derived_id", F.lit("'")).alias("reason"))
    fixed_terms = leaves.unionByName(failed_links)
    settled, pending = None, numbered
    for level in range(DEEPEST + 1):
        open_links = known.join(pending.select("run", "proposal_id"), ["run", "proposal_id"], "left_semi")
        if settled is None:
            ready = pending.join(open_links.select("run", "proposal_id").distinct(), ["run", "proposal_id"], "left_anti")
            upstream = None
        else:
            waiting = open_links.join(pending.select("run", F.col("proposal_id").alias("derived_id")), ["run", "derived_id"], "left_semi")
            ready = pending.join(waiting.select("run", "proposal_id").distinct(), ["run", "proposal_id"], "left_anti")
            upstream = open_links.join(settled.select("run", F.col("proposal_id").alias("derived_id"), "value", "uncertainty", "unit", "display", F.col("derived_id").alias("_name"), F.col("depth").alias("_depth"), F.col("reason").alias("_reason")), ["run", "derived_id"])
            upstream = upstream.select(
                "run", "proposal_id", "place", (F.col("_depth") + 1).alias("depth"), "value", F.col("uncertainty").alias("half"), "unit", F.concat(F.lit("["), "_name", F.lit("] "), "display").alias("shown"), null.alias("found_in"), _not_valid("derived_id", F.col("_reason").isNotNull()).alias("reason"), F.col("_name").alias("_on")
            )
        solved = _level(ready, fixed_terms, upstream)
        solved = saved(solved)
        settled = solved if settled is None else saved(settled.unionByName(solved))
        pending = saved(numbered.join(settled.select("run", "proposal_id"), ["run", "proposal_id"], "left_anti"))
        if pending.isEmpty():
            return settled
    # None of these has a result: what they wait for is on a cycle, or has none either.
    cyclic = on_cycles(_edges(pending)).withColumn("_cyclic", F.lit(True))
    open_links = known.join(pending.select("run", "proposal_id"), ["run", "proposal_id"], "left_semi")
    results = settled.where("reason is null").select("run", F.col("proposal_id").alias("derived_id"))
    broken = open_links.join(results, ["run", "derived_id"], "left_anti").select("run", "proposal_id", "place", _not_valid("derived_id", F.lit(True)).alias("reason"))
    first = broken.unionByName(fixed_terms.where("reason is not null").select("run", "proposal_id", "place", "reason")).groupBy("run", "proposal_id").agg(F.min(F.struct("place", "reason")).alias("_first"))
    left = pending.join(first, ["run", "proposal_id"]).join(cyclic, ["run", "proposal_id"], "left")
    on_cycle = F.concat(F.lit("derivation cycle: "), "proposal_id", F.lit(" takes part in a circular reference"))
    too_few = F.size("operands") < 2
    reason = F.when(F.col("_cyclic"), on_cycle).when(too_few, "a derivation needs at least two operands").otherwise(F.col("_first.reason"))
    rest = left.select("run", "proposal_id", letter_id(F.col("position"), "D").alias("derived_id"), *(F.lit(None).cast(settled.schema[c].dataType).alias(c) for c in settled.columns[3:-1]), reason.alias("reason"))
    return settled.unionByName(rest)


def _not_valid(name: str, when: Column) -> Column:
    return F.when(when, F.concat(F.lit("operand depends on derivation '"), name, F.lit("', which did not validate")))


def _level(ready: DataFrame, fixed_terms: DataFrame, upstream: DataFrame | None) -> DataFrame:
    """The results of proposals whose operands are all known."""
    terms = fixed_terms.withColumn("_on", F.lit(None).cast("string"))
    if upstream is not None:
        terms = terms.unionByName(upstream)
    held = terms.join(ready.select("run", "proposal_id"), ["run", "proposal_id"], "left_semi").groupBy("run", "proposal_id").agg(F.array_sort(F.collect_list(F.struct("place", "value", "half", "unit", "shown", "found_in", "reason", "depth", "_on"))).alias("_terms"))
    rows = ready.join(held, ["run", "proposal_id"], "left")
    failed = F.get(F.filter("_terms", lambda t: t["reason"].isNotNull()), F.lit(0))["reason"]
    depth = F.coalesce(F.array_max(F.transform("_terms", lambda t: t["depth"])), F.lit(1))
    early = (
        F.when(F.size("operands") < 2, "a derivation needs at least two operands")
        .when(failed.isNotNull(), failed)
        .when(depth > DEEPEST, F.concat(F.lit("derivation chain is "), depth, F.lit(f" deep, over the limit of {DEEPEST}")))
    )
    rows = rows.select("run", "proposal_id", "position", "op", "precision", "_terms", depth.alias("depth"), early.alias("_early"))
    quantities = F.transform("_terms", lambda t: F.struct(t["value"].alias("value"), t["half"].alias("half"), t["unit"].alias("unit")))
    tried = rows.where("_early is null").withColumn("_s", _solved("op", quantities, "precision"))
    rows = tried.unionByName(rows.where("_early is not null"), allowMissingColumns=True)
    ok = F.col("_early").isNull() & F.col("_s.reason").isNull()
    symbols = F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))

    def held_by(field: str) -> Column:
        return F.when(ok, F.array_compact(F.transform("_terms", lambda t: t[field])))

    return rows.select(
        "run",
        "proposal_id",
        letter_id(F.col("position"), "D").alias("derived_id"),
        *(F.when(ok, F.col(f"_s.{c}")).alias(c) for c in ("value", "unit", "display")),
        F.when(ok, F.call_function("array_join", F.transform("_terms", lambda t: t["shown"]), F.try_element_at(symbols, F.col("op")))).alias("formula"),
        *(F.when(ok, F.col(f"_s.{c}")).alias(c) for c in ("tolerance", "uncertainty")),
        held_by("_on").alias("depends_on"),
        F.when(ok, F.col("depth")).alias("depth"),
        held_by("found_in").alias("found_in"),
        F.coalesce("_early", "_s.reason").alias("reason"),
    )
