"""How figures of sources justify figures of statements, as keys that both have.

A printed figure offers keys, a stated one wants keys; one that both have is a
justification, and the first of its RULES counts.  So every rule is a part of
one equi-join: nothing is compared within a run or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: same: equal quantity and unit.  printed: a stated bare figure, the printed
#: figure of an amount.  cell: a stated percentage, a bare cell under a `(%)`
#: heading.  declared: a stated amount, a bare figure and the unit that its
#: document declares.
RULES = ("same", "printed", "cell", "declared")


def exploded(df: DataFrame, array: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each figure of the array column: the kept columns, place (from 0) and the figure's fields."""
    keys = [c for c in df.columns if c != array] if keep is None else keep
    # Of a bare column Spark would ask whether it is empty below, and run the helper that made it once more for that.
    return df.select(*keys, F.posexplode(F.array_compact(array)).alias("place", "_f")).select(*keys, "place", "_f.*")


def _key(rule: str, *parts: Column) -> Column:
    return F.struct(F.lit(RULES.index(rule)).alias("rule"), F.concat_ws("\x1f", F.lit(rule), *parts).alias("key"))


def offers(hints: Column) -> Column:
    """(rule, key, source) that a printed figure (columns kind, value, unit, numeric_raw, multiplier) offers under its document's hints."""
    kind, value = F.col("kind"), F.col("value")
    bare = F.when((kind == "amount") & (F.col("multiplier") == "1"), F.col("numeric_raw")).when(kind.isin("percent", "scalar", "multiple"), value)

    def with_source(k: Column, source: Column) -> Column:
        return F.struct(k["rule"].alias("rule"), k["key"].alias("key"), source.cast("string").alias("source"))

    plain = F.array(
        with_source(_key("same", F.col("unit"), value), F.lit(None)),
        F.when(kind == "amount", with_source(_key("printed", F.col("numeric_raw")), F.lit(None))),
    )
    cells = F.transform(F.filter(hints, lambda h: (h["unit"] == "percent") & F.coalesce(F.array_contains(h["figures"], value), F.lit(False))), lambda h: F.when(kind == "scalar", with_source(_key("cell", value), h["source"])))
    declared = F.transform(hints, lambda h: F.when(bare.isNotNull(), with_source(_key("declared", h["unit"], h["multiplier"], bare), h["source"])))
    return F.array_compact(F.concat(plain, cells, declared))


def wants() -> Column:
    """(rule, key) that a stated figure is justified by."""
    kind, value = F.col("kind"), F.col("value")
    return F.array_compact(
        F.array(
            _key("same", F.col("unit"), value),
            F.when(kind == "scalar", _key("printed", value)),
            F.when(kind == "percent", _key("cell", value)),
            F.when(kind == "amount", _key("declared", F.col("unit"), F.col("multiplier"), F.col("numeric_raw"))),
        )
    )


def is_year() -> Column:
    """Whether a figure may be a bare year."""
    return (F.col("kind") == "scalar") & F.col("value").rlike(r"^(?:19[0-9]{2}|20[0-9]{2}|2100)$")
