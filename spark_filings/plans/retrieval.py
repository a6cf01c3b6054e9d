"""Retrieval queries: questions against the passages of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quotable_fragments, semantic_units, split_passages
from ..operators.recipes import key_units


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Questions' units are broadcast up to so many rows.
BROADCAST_ROWS = 200_000


#: What a digit adds to the points of a passage (0.35 of 20) if numbers are preferred.
NUMBER_POINTS = 7


class UnitIndex:
    """Which questions have each unit, for questions of a checked number of units."""

    def __init__(self, rows: pa.Table) -> None:
        units, items = rows.column("unit").combine_chunks(), rows.column("item").to_numpy()
        self.units = units.unique()
        place = pc.index_in(units, self.units).to_numpy()
        order = np.argsort(place, kind="stable")
        self.items = items[order]
        self.starts = np.searchsorted(place[order], np.arange(len(self.units) + 1))
        self.sizes = np.bincount(items)

    def shared(self, batch: pa.RecordBatch, least: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, question, shared units) for rows of `units` that have `least` of a question's, or by default more than a quarter."""
        lists = batch.column(batch.schema.get_field_index("units"))
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        found = pc.index_in(lists.flatten(), self.units)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        unit, row = found.drop_null().to_numpy(), row[known]
        n = self.starts[unit + 1] - self.starts[unit]
        item = self.items[np.repeat(self.starts[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        counts = np.bincount(np.repeat(row, n) * len(self.sizes) + item, minlength=len(lists) * len(self.sizes))
        counts = counts.reshape(len(lists), len(self.sizes))
        row, item = np.nonzero(counts * 4 > np.maximum(self.sizes, 1) if least is None else counts >= least)
        return row, item, counts[row, item]


def _meet(index, keep: list[str], least: int | None, best: str | None):
    """From passages the rows (item, *keep, n_shared) that meet a question.

    With `best` a task leaves out what a row it has seen beats: fewer shared
    units, or as many and more of the column `best`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.full(len(index.value.sizes), -1, dtype=np.int64)
        for batch in batches:
            # A matrix of rows and questions at a time, of bounded size.
            step = max(1, 4_000_000 // max(1, len(index.value.sizes)))
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                row, item, n = index.value.shared(some, least)
                if best:
                    # One number that is greater for a better row; the column is below 2**32.
                    rank = (n.astype(np.int64) << 32) - some.column(some.schema.get_field_index(best)).to_numpy(zero_copy_only=False)[row]
                    np.maximum.at(seen, item, rank)
                    row, item, n = (x[rank == seen[item]] for x in (row, item, n))
                held = [some.column(some.schema.get_field_index(c)).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), *held, pa.array(n.astype(np.int64))], names=["item", *keep, "n_shared"])

    return run


def _met(passages: DataFrame, wanted: DataFrame, keep: list[str], least: int | None = None, best: str | None = None) -> DataFrame:
    """(item_id, n_units, *keep, n_shared) of passages with `least` of a question's units, or more than a quarter of them.

    With `best`, passages may be left out that share fewer units with a question
    than another, or as many and have more in the column of that name.

    Questions of few units are looked up in place, so nothing is shuffled but
    what passes.  Otherwise both sides meet by the rarer units: what has more
    than a quarter of a question's units has one that is left when as many of
    its most frequent ones are set aside as a quarter holds.
    """
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        items = wanted.select("item_id", "n_units").distinct().toArrow()
        if not items.num_rows:
            return wanted.select("item_id", "n_units").where("false").crossJoin(passages.select(*keep, F.lit(0).cast("long").alias("n_shared")).where("false"))
        asked = wanted.select("item_id", "unit").toArrow()
        numbered = asked.append_column("item", pc.index_in(asked.column("item_id"), items.column("item_id").combine_chunks()))
        index = passages.sparkSession.sparkContext.broadcast(UnitIndex(numbered))
        types = passages.schema
        ddl = ", ".join(["item long", *(f"{c} {types[c].dataType.simpleString()}" for c in keep), "n_shared long"])
        names = passages.sparkSession.createDataFrame(items.append_column("item", pa.array(range(items.num_rows), pa.int64())))
        found = passages.select(*keep, "units").mapInArrow(_meet(index, keep, least, best), ddl)
        return found.join(F.broadcast(names), "item").select("item_id", "n_units", *keep, "n_shared")
    counts = passages.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    ranked = wanted.join(counts, "unit", "left").withColumn("rarity", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "unit")))
    aside = F.floor(F.col("n_units") / 4) if least is None else F.lit(least - 1)
    rare = ranked.where(F.col("rarity") <= F.col("n_units") - aside).select("item_id", "wanted", "n_units", "unit")
    met = passages.withColumn("unit", F.explode("units")).join(rare, "unit")
    shared = F.array_intersect("wanted", "units")
    # Of the units that both have, one stands for the pair.
    met = met.withColumn("n_shared", F.size(shared).cast("long")).where(F.col("n_shared") * 4 > F.col("n_units") if least is None else F.col("n_shared") >= least)
    return met.select("item_id", "n_units", *keep, "n_shared").distinct()


def candidate_passages(passages: DataFrame, asked: DataFrame, k: int = 3, at: tuple[str, ...] = ("passage_no",), prefer_numbers: bool = False) -> DataFrame:
    """The k passages that cover most of each question, from (doc_id, *at, n_chars, units) and (item_id, units).

    A passage counts if it has more than a quarter of the question's units.  A
    question without units is covered by every passage: its k passages are the
    first in the order of ties.  With `prefer_numbers`, passages have a column
    `digits`, and one with a digit has NUMBER_POINTS more.
    """
    more = F.when(F.col("digits"), NUMBER_POINTS).otherwise(0) if prefer_numbers else F.lit(0)
    wanted = asked.select("item_id", F.col("units").alias("wanted"), F.size("units").cast("long").alias("n_units"), F.explode("units").alias("unit"))
    keep = ["doc_id", *at, "n_chars", *(["digits"] if prefer_numbers else [])]
    scored = _met(passages, wanted, keep)
    points = (F.round(F.col("n_shared") * 20 / F.col("n_units")) + more).cast("long")
    scored = scored.select("item_id", "doc_id", *at, "n_chars", "n_shared", points.alias("points"))
    ties = [F.desc("points"), "n_chars", "doc_id", *at]
    blank = asked.where(F.size("units") == 0).select("item_id")
    if not blank.isEmpty():
        first = passages.select("doc_id", *at, "n_chars", F.lit(0).cast("long").alias("n_shared"), (F.lit(20) + more).cast("long").alias("points")).orderBy(*ties).limit(k)
        scored = scored.unionByName(blank.crossJoin(F.broadcast(first)))
    order = Window.partitionBy("item_id").orderBy(*ties)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages that cover most of each benchmark item's words."""
    passages = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_passages(F.col("text"))).alias("passage_no", "passage"))
    passages = passages.select("doc_id", "passage_no", F.length("passage").alias("n_chars"), semantic_units(F.col("passage")).alias("units"))
    asked = _table(spark, sf_dir, "benchmark").select("item_id", semantic_units(F.col("text")).alias("units"))
    return candidate_passages(passages, asked).select("item_id", "place", "doc_id", "passage_no", "n_shared", "points")


def fragments_of(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, passage_no, fragment_no, n_chars, digits, units): trimmed quotable fragments of at least so many characters."""
    passages = docs.select("doc_id", F.posexplode(split_passages(F.col("text"))).alias("passage_no", "passage"))
    pieces = passages.select("doc_id", "passage_no", F.posexplode(quotable_fragments(F.col("passage"))).alias("fragment_no", "fragment"))
    pieces = pieces.withColumn("fragment", F.regexp_replace("fragment", r"^\s+|\s+$", "")).where(F.length("fragment") >= least)
    return pieces.select("doc_id", "passage_no", "fragment_no", "fragment", F.length("fragment").alias("n_chars"), F.col("fragment").rlike("[0-9]").alias("digits"), semantic_units(F.col("fragment")).alias("units"))


#: Wording that reports that something is not disclosed or has not happened.
ABSENCE_WORDING = (
    "尚未|仍未|暂未|暫未|尚无|尚無|暂无|暫無|未确定|未確定|未指定|未披露|未揭露|未提及|未说明|未說明|未明确|未明確|无法核实|無法核實|没有披露|沒有揭露|尚需|尚待|"
    "not yet|has not|have not|not disclosed|not stated|not specified|undetermined"
)


def nearest_fragments(docs: DataFrame, asked: DataFrame, accept: Column | None = None) -> DataFrame:
    """(item_id, doc_id, fragment, n_shared): the fragment of ten characters or more that shares most distinctive units with a question, two at least."""
    pieces = fragments_of(docs, 10)
    pieces = pieces if accept is None else pieces.where(accept)
    wanted = asked.select("item_id", key_units(F.col("text")).alias("wanted"))
    wanted = wanted.select("item_id", "wanted", F.size("wanted").cast("long").alias("n_units"), F.explode("wanted").alias("unit"))
    met = _met(pieces, wanted, ["doc_id", "n_chars", "fragment"], 2, "n_chars")
    order = Window.partitionBy("item_id").orderBy(F.desc("n_shared"), "n_chars", "doc_id", "fragment")
    return met.withColumn("place", F.row_number().over(order)).where("place = 1").select("item_id", "doc_id", "fragment", "n_shared")


def supporting_fragments(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id, fragment, n_markers, n_shared): of fragments that report an absence and share a distinctive unit with a question, the most explicit."""
    markers = F.size(F.array_distinct(F.regexp_extract_all("fragment", F.lit(ABSENCE_WORDING), F.lit(0)))).cast("long")
    pieces = fragments_of(docs, 10).withColumn("n_markers", markers).where("n_markers > 0")
    wanted = asked.select("item_id", key_units(F.col("text")).alias("wanted"))
    wanted = wanted.select("item_id", "wanted", F.size("wanted").cast("long").alias("n_units"), F.explode("wanted").alias("unit"))
    met = _met(pieces, wanted, ["doc_id", "passage_no", "fragment_no", "n_chars", "fragment", "n_markers"], 1)
    order = Window.partitionBy("item_id").orderBy(F.desc("n_markers"), F.desc("n_shared"), "n_chars", "doc_id", "passage_no", "fragment_no")
    return met.withColumn("place", F.row_number().over(order)).where("place = 1").select("item_id", "doc_id", "fragment", "n_markers", "n_shared")


def passages_containing(figures: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """(run, place, doc_id, passage_no) of the first k passages (run, doc_id, passage_no, passage) of a run that hold one of its figures (run, raw) verbatim.

    Both sides meet by the runs of digits that they have, then the figure is
    looked for as it is written.
    """

    def digits(text: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))

    asked = figures.select("run", "raw", F.element_at(digits("raw"), 1).alias("key")).where("key is not null").distinct()
    held = passages.withColumn("key", F.explode(digits("passage")))
    met = held.join(asked, ["run", "key"]).where(F.col("passage").contains(F.col("raw"))).select("run", "doc_id", "passage_no").distinct()
    order = Window.partitionBy("run").orderBy("doc_id", "passage_no")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("run", "place", "doc_id", "passage_no")


def top_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quotable fragments that cover most of each benchmark item's words, those with figures first."""
    asked = _table(spark, sf_dir, "benchmark").select("item_id", semantic_units(F.col("text")).alias("units"))
    found = candidate_passages(fragments_of(_table(spark, sf_dir, "documents")), asked, at=("passage_no", "fragment_no"), prefer_numbers=True)
    return found.select("item_id", "place", "doc_id", "passage_no", "fragment_no", "n_shared", "points")


TOP_PASSAGES_SQL = r"""
WITH passages AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([!?;。！？；]+)', '\1' || chr(10), 'g'), '\n'),
         lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '')) AS passage,
         generate_subscripts(list_filter(list_transform(string_split_regex(regexp_replace(text, '([!?;。！？；]+)', '\1' || chr(10), 'g'), '\n'),
         lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> ''), 1) - 1 AS passage_no
  FROM documents
), units AS (
  SELECT doc_id, passage_no, length(passage) AS n_chars,
         unnest(list_distinct(regexp_extract_all(lower(passage), '[a-z]+(?:''[a-z]+)?') || regexp_extract_all(lower(passage), '[0-9]+(?:\.[0-9]+)?'))) AS unit
  FROM passages
), asked AS (
  SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') || regexp_extract_all(lower(text), '[0-9]+(?:\.[0-9]+)?')) AS us FROM benchmark
), terms AS (SELECT item_id, len(us) AS n_units, unnest(us) AS unit FROM asked),
shared AS (
  SELECT item_id, n_units, doc_id, passage_no, n_chars, count(*) AS n_shared
  FROM units JOIN terms USING (unit) GROUP BY ALL
), scored AS (
  SELECT *, CAST(round(n_shared * 20.0 / n_units) AS BIGINT) AS points FROM shared WHERE n_shared * 4 > n_units
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY points DESC, n_chars, doc_id, passage_no) AS place FROM scored
)
SELECT item_id, place, doc_id, passage_no, n_shared, points FROM ranked WHERE place <= 3
"""

def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_fragments(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "doc_id", F.sha2("fragment", 256).alias("fragment_sha256"), "n_shared")


def supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement about a customer that best says of each market segment that an account is not known."""
    customers = _table(spark, sf_dir, "customer")
    docs = customers.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("All is well. The account of "), "c_name", F.lit(" in "), "c_mktsegment", F.lit(" is not yet stated; it has no end")).alias("text"))
    asked = customers.select(F.col("c_mktsegment").alias("item_id"), F.concat(F.lit("Which account is in "), "c_mktsegment").alias("text")).distinct()
    found = supporting_fragments(docs, asked)
    return found.select("item_id", "doc_id", F.sha2("fragment", 256).alias("fragment_sha256"), "n_markers", "n_shared")


SUPPORTING_SQL = """
WITH f AS (SELECT c_mktsegment AS item_id, c_custkey AS doc_id, 'All is well. The account of ' || c_name || ' in ' || c_mktsegment || ' is not yet stated;' AS t FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(t), doc_id) AS place FROM f)
SELECT item_id, doc_id, sha256(t) AS fragment_sha256, CAST(1 AS BIGINT) AS n_markers, CAST(3 AS BIGINT) AS n_shared FROM r WHERE place = 1
"""


def figure_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of a customer's orders that name one of the order keys of the customer's urgent orders."""
    orders = _table(spark, sf_dir, "orders")
    passages = orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("passage_no"), F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("passage"))
    figures = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("run"), F.concat(F.lit("er "), "o_orderkey").alias("raw"))
    return passages_containing(figures, passages).select("run", "place", "doc_id")


FIGURE_PASSAGES_SQL = """
WITH u AS (SELECT o_custkey AS run, o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT DISTINCT o_custkey AS run, o_orderkey AS doc_id FROM orders JOIN u ON o_custkey = run AND o_orderkey = k),
r AS (SELECT run, doc_id, row_number() OVER (PARTITION BY run ORDER BY doc_id) AS place FROM m)
SELECT run, place, doc_id FROM r WHERE place <= 3
"""

QUERIES = {"top_passages": top_passages, "top_fragments": top_fragments, "nearest": nearest, "supporting": supporting, "figure_passages": figure_passages}
ORACLES = {"top_passages": TOP_PASSAGES_SQL, "figure_passages": FIGURE_PASSAGES_SQL, "supporting": SUPPORTING_SQL}
