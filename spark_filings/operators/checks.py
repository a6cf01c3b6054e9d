"""Checks of references, quotes and overlap, as joins and aggregations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import code_points, gram_hashes
from ..functions.text import coverage, has_open_end, semantic_units

#: A side of a join is broadcast up to so many rows.
BROADCAST_ROWS = 50_000


def dangling(rows: DataFrame, keys: list[str], known: DataFrame, known_keys: list[str], code: str) -> DataFrame:
    """(code, reference) for rows whose reference does not exist; null references are none."""
    right = known.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(known_keys))).distinct()
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    rows = rows.dropna(subset=keys)
    return rows.join(right, on, "left_anti").select(F.lit(code).alias("code"), F.concat_ws(":", *keys).alias("reference"))


def repeated(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(code, reference) for each key that occurs more than once."""
    return rows.groupBy(*keys).count().where("count > 1").select(F.lit(code).alias("code"), F.concat_ws(":", *keys).alias("reference"))


def character_grams(df: DataFrame, id_col: str, text_col: str, size: int, stride: int = 1) -> DataFrame:
    """(id, gram): runs of `size` characters of the text without white space, every `stride` characters."""
    # A lookahead matches at every character, so a text is read once.
    grams = F.regexp_extract_all(F.regexp_replace(F.col(text_col), r"\s+", ""), F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
    if stride > 1:
        grams = F.filter(grams, lambda g, i: i % stride == 0)
    return df.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram"))


def _held_grams(texts: DataFrame, grams: list[str], size: int) -> DataFrame:
    """(gram): those of some grams that are in the texts, repeated at most once a text.

    A text's grams are hashed where they stand, and only those whose hash one
    of the given has are made.
    """
    wanted = np.unique(np.array([gram_hashes(code_points(g), size)[0] for g in grams], dtype=np.uint64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                text = re.sub("[ \t\n\x0b\f\r]+", "", text or "")
                hashed = gram_hashes(code_points(text), size)
                at = np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)
                found.update(text[i : i + size] for i in np.flatnonzero(wanted[at] == hashed).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["gram"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "gram string")


def contamination(texts: DataFrame, text_id: str, gold: DataFrame, gold_id: str, size: int = 8, stride: int = 4) -> DataFrame:
    """(gold_id, n_grams, n_found): how many runs of each gold text occur in the texts.

    Grams are the equi-join key.  The texts' side is reduced to the distinct
    grams that gold has before it is shuffled any further: in place where gold
    has few, which are counted first, and else by a join.
    """
    asked = character_grams(gold, gold_id, "text", size, stride).distinct()
    wanted = [r[0] for r in asked.select("gram").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if 0 < len(wanted) <= BROADCAST_ROWS:
        held = _held_grams(texts, wanted, size).distinct()
    else:
        held = character_grams(texts, text_id, "text", size).select("gram").join(asked.select("gram").distinct(), "gram", "left_semi").distinct()
    found = held.withColumn("_hit", F.lit(1))
    return asked.join(found, "gram", "left").groupBy(F.col("id").alias(gold_id)).agg(F.count("*").alias("n_grams"), F.count("_hit").alias("n_found"))


def quoted_in(texts: DataFrame, text_id: str, quotes: DataFrame, quote_id: str, key: int = 24) -> DataFrame:
    """(quote_id, text_id) for texts that hold a quote verbatim.

    Texts meet quotes by the quote's first `key` characters, then the whole is
    compared; quotes of fewer characters are looked up by their own length,
    each of the at most `key` lengths on its own.
    """
    asked = quotes.select(F.col(quote_id), F.col("text").alias("quote")).where("length(quote) > 0")
    lengths = [r[0] for r in asked.select(F.least(F.length("quote"), F.lit(key))).distinct().collect()]
    met = None
    for n in sorted(lengths):
        own = asked.where(F.least(F.length("quote"), F.lit(key)) == n).select(quote_id, F.xxhash64(F.substring("quote", 1, n)).alias("gram"))
        grams = F.transform(F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.xxhash64(g))
        # Hashes only propose; no text goes along with them.
        places = texts.select(F.col(text_id), F.explode(grams).alias("gram"))
        small = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        pairs = places.join(F.broadcast(own) if small else own, "gram").select(quote_id, text_id)
        met = pairs if met is None else met.unionByName(pairs)
    if met is None:
        return asked.join(texts, F.lit(False)).select(quote_id, text_id)
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = met.distinct().join(texts.select(text_id, "text"), text_id).join(F.broadcast(asked) if few else asked, quote_id)
    return met.where(F.col("text").contains(F.col("quote"))).select(quote_id, text_id).distinct()


def join_open(passages: DataFrame, keys: list[str], order: str, text_col: str, longest: int = 240) -> DataFrame:
    """Add `joined`: each passage with those that follow it, while ends are open and the span is short enough.

    What follows is cut just beyond `longest`, as a longer passage joins none;
    with its separator a passage takes two characters at least.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, longest // 2)
    ahead = F.collect_list(F.substring(text_col, 1, longest + 1)).over(window)

    def extend(done: Column, passage: Column) -> Column:
        fits = F.length(done["text"]) + 1 + F.length(passage) <= longest
        more = ~done["closed"] & has_open_end(done["text"]) & fits
        return F.when(more, F.struct(F.concat_ws("\n", done["text"], passage).alias("text"), F.lit(False).alias("closed"))).otherwise(
            F.struct(done["text"].alias("text"), F.lit(True).alias("closed"))
        )

    start = F.struct(F.col(text_col).alias("text"), F.lit(False).alias("closed"))
    return passages.withColumn("_ahead", ahead).withColumn("joined", F.aggregate("_ahead", start, extend)["text"]).drop("_ahead")


#: Ends of lines as in Python's splitlines.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def points_covered(answers: DataFrame, points: DataFrame, key: str, least: float, marker: str | None = None, whole: bool = False) -> DataFrame:
    """(answer_id, n_points, n_covered, score): shares of a task's points that an answer covers.

    A point is covered if some line of the answer has the share `least` of its
    units; with `whole`, if the whole answer has.  With a marker, a line counts
    only if it matches it.  A point without units is covered by any line, or
    by any whole answer.  An answer whose task has no points scores 1.

    Texts meet points by (task, unit).  What covers a point still has one of
    its units when as many of the most frequent as `least` allows to miss the
    rest are set aside, so only the rarer ones are joined.
    """
    if whole:
        parts = answers.select("answer_id", key, F.coalesce("output", F.lit("")).alias("part"))
    else:
        parts = answers.select("answer_id", key, F.explode(F.split("output", LINE_ENDS)).alias("part")).where(r"part rlike '\\S'")
    if marker is not None:
        parts = parts.where(F.col("part").rlike(marker))
    parts = parts.select("answer_id", key, semantic_units(F.col("part")).alias("units"))
    asked = points.select(key, "point_id", semantic_units(F.col("point")).alias("wanted"))
    wanted = asked.select(key, "point_id", "wanted", F.explode("wanted").alias("unit"))
    counts = parts.select(key, F.explode("units").alias("unit")).groupBy(key, "unit").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key, "point_id").orderBy(F.coalesce("n", F.lit(0)), "unit")
    ranked = wanted.join(counts, [key, "unit"], "left").withColumn("rarity", F.row_number().over(order))
    rare = ranked.where(F.col("rarity") <= F.size("wanted") - F.greatest(F.ceil(F.size("wanted") * least - 1e-9), F.lit(1)) + 1).select(key, "unit", "point_id", "wanted")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = parts.withColumn("unit", F.explode("units")).join(F.broadcast(rare) if small else rare, [key, "unit"])
    hits = met.where(coverage(F.col("wanted"), F.col("units")) >= least).select("answer_id", "point_id").distinct().groupBy("answer_id").agg(F.count("*").alias("n_hits"))
    free = asked.where(F.size("wanted") == 0).groupBy(key).agg(F.count("*").alias("n_free"))
    given = parts.select("answer_id", key).distinct().join(free, key).select("answer_id", "n_free")
    totals = asked.groupBy(key).agg(F.count("*").alias("n_points"))
    out = answers.select("answer_id", key).join(totals, key, "left").join(hits, "answer_id", "left").join(given, "answer_id", "left").na.fill(0, ["n_points", "n_hits", "n_free"])
    out = out.withColumn("n_covered", F.col("n_hits") + F.col("n_free"))
    return out.select("answer_id", "n_points", "n_covered", F.when(F.col("n_points") == 0, F.lit(1.0)).otherwise(F.round(F.col("n_covered") / F.col("n_points"), 6)).alias("score"))
