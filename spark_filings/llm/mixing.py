"""Mixing sources to target weights by the cube method.

A source's documents share one rate: the words it should give over the words
it has.  Each document is taken floor(rate) times, and once more with the
fractional part as its inclusion probability.  The cube method decides these:
a document's column is (1, size), and probabilities move along vectors in the
null space of three such columns, which keeps the expected document and word
totals, until all but two of a block are 0 or 1.

Blocks are bounded, whatever the size of a source.  What a block leaves open
moves on to the next level, where some thousands of blocks make one; at the
last level of a source at most two documents are open.  The landing is a small
program over these and some others of the block, of all sizes: of all choices
the one that misses the word total least, then the document total.

Documents of more than a two-hundredth of their source's words (fewer than two
hundred in each source) are decided first, as no others could balance them
later.  The probabilities of the rest then move linearly in the size, so that
they make up for what this missed in words and documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, column, saved, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3

#: Documents that a block of the flight phase holds on average.
BLOCK_ROWS = 4096

#: A document of more than this part of its source's words is decided before the others.
LARGE_PART = 1 / 200

#: Documents whose choices the landing weighs against each other (all of them, so 2 to this power), how often it
#: looks at others, and the part of the word total that it takes for met.
LANDING = 12
LANDINGS = 4
MET = 1 / 1000

#: Tables with a row for each source are broadcast up to so many rows.
BROADCAST_SOURCES = 50_000

_ROW = "_id {id}, _key long, _null boolean, _source string, _size long, _times long, _base long, _p double"


def word_count(text: Column) -> Column:
    """Words of a text: pieces between white space, without the empty first and last."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE)

    def count(p: Column) -> Column:
        head = (F.get(p, F.lit(0)) == "").cast("int")
        tail = ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
        return (F.size(p) - head - tail).cast("long")

    return F.element_at(F.transform(F.array(pieces), count), 1)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add `target` to a table (_null, _source, source_size) with a row for each source.

    Weights go round by code point of the source, null last.  The total of all
    sizes is shared by weight; a source's target stops at `max_repeat` times
    its size and the excess is shared again, until none is above.
    """
    spark = sources.sparkSession
    # Places in the global order without one task for all: rows are dealt by range and numbered within it.
    parts = saved(sources.repartitionByRange("_null", "_source").withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        starts.append((part, before))
        before += n
    if not starts:
        return sources.withColumn("target", F.lit(0.0))
    offsets = spark.createDataFrame(starts, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_source")) - 1 + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    placed = saved(parts.join(F.broadcast(offsets), "_part").withColumn("_weight", weight.cast("long")).drop("_part", "_before"))

    def capped(share: float) -> Column:
        return F.col("_weight") * F.lit(share) > max_repeat * F.col("source_size")

    total, free_weight = placed.agg(F.sum("source_size"), F.sum("_weight")).first()
    share, n_capped = total / free_weight, -1
    while True:
        held, free, n = placed.agg(
            F.coalesce(F.sum(F.when(capped(share), F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped(share), F.col("_weight"))), F.lit(0)),
            F.count(F.when(capped(share), 1)),
        ).first()
        if n == n_capped or not free:
            break
        share, n_capped = (total - max_repeat * held) / free, n
    target = F.least(F.col("_weight") * F.lit(float(share)), (max_repeat * F.col("source_size")).cast("double"))
    return placed.withColumn("target", target).drop("_weight")


def _attach(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join what is known of each source; a frequent source skews no task."""
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if small else sources, ["_null", "_source"])


def _land(size: np.ndarray, start: np.ndarray, p: np.ndarray, held: list[int]) -> None:
    """Decide the open documents `held` in `p`, and revise some others, so that sums are near those of `start`."""
    wanted, docs = math.fsum(size * start), math.fsum(start)
    free = np.flatnonzero((start > 0) & (start < 1))
    by_size = [k for k in free[np.argsort(size[free], kind="stable")].tolist() if k not in held]
    for turn in range(LANDINGS):
        room = LANDING - len(held)
        # Documents of all sizes, others in each turn.
        spread = np.linspace(0, len(by_size) - 1, room + turn).round().astype(int)[:room] if len(by_size) > room else range(len(by_size))
        some = np.array([*held, *dict.fromkeys(by_size[k] for k in spread)], dtype=np.int64)
        if not len(some):
            return
        choices = (np.arange(1 << len(some))[:, None] >> np.arange(len(some))) & 1
        rest = np.ones(len(p), dtype=bool)
        rest[some] = False
        miss = np.abs(choices @ size[some] + math.fsum(size[rest] * p[rest]) - wanted)
        off = np.abs(choices.sum(axis=1) + math.fsum(p[rest]) - docs)
        changed = (choices != np.round(p[some])).sum(axis=1)
        best = np.lexsort((miss, changed, off, np.maximum(miss, MET * wanted)))[0]
        p[some] = choices[best]
        held = []
        if miss[best] <= MET * wanted or len(by_size) <= room:
            return


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(size * p), until at most two are open.

    `land` decides those two as well, with some others.
    """
    start = p
    p = p.tolist()
    s = size.tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    tiny = 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if tiny < p[i] < 1 - tiny:
            held.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(held) == 3:
            a, b, c = held
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1, -1, 0)
            up = down = math.inf
            for k, x in zip(held, u):
                if x > 0:
                    up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
                elif x < 0:
                    up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
            step = up if next(draws) * (up + down) < down else -down
            left = []
            for k, x in zip(held, u):
                v = p[k] + step * x
                if tiny < v < 1 - tiny:
                    p[k] = v
                    left.append(k)
                else:
                    p[k] = 0.0 if v < 0.5 else 1.0
            held = left
    out = np.array(p)
    if land:
        _land(size.astype(float), np.array(start), out, held)
    return out


def _level(rows: DataFrame, schema: str, seed: int, level: int, block_rows: int) -> DataFrame:
    counts = rows.groupBy("_null", "_source").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("_blocks"))
    dealt = _attach(rows, saved(counts)).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(level)), F.col("_blocks")))

    def move(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_key", "_size"], kind="stable")
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(key[1]).encode()), int(key[2])])
        group["_p"] = flight(group["_size"].to_numpy(), group["_p"].to_numpy(), rng, int(group["_blocks"].iloc[0]) == 1)
        return group.drop(columns=["_blocks", "_block"])

    names = [x.split()[0] for x in schema.split(", ")]
    return dealt.select(*names, "_blocks", "_block").groupBy("_null", "_source", "_block").applyInPandas(move, schema)


def _decide_large(rows: DataFrame, sources: DataFrame, schema: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Settled large rows, and the others with probabilities that make up for the miss."""
    marked = _attach(rows, sources.select("_null", "_source", "source_size")).withColumn("_large", F.col("_size") > F.col("source_size") * LARGE_PART)

    def land(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", "_key"], ascending=False, kind="stable")
        rng = np.random.default_rng([seed, 99, zlib.crc32(repr(key[1]).encode())])
        group["_p"] = flight(group["_size"].to_numpy(), group["_p"].to_numpy(), rng, True)
        return group

    names = [x.split()[0] for x in schema.split(", ")]
    settled = saved(marked.where("_large").select(*names).groupBy("_null", "_source").applyInPandas(land, schema))
    size = F.col("_size").cast("double")

    def sums(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy("_null", "_source").agg(F.sum(sign * F.col("_p")).alias("_docs"), F.sum(sign * F.col("_p") * size).alias("_words"))

    missed = sums(marked.where("_large"), 1).unionByName(sums(settled, -1)).groupBy("_null", "_source").agg(F.sum("_docs").alias("_docs"), F.sum("_words").alias("_words"))
    others = marked.where("not _large")
    moments = others.where("_p > 0").groupBy("_null", "_source").agg(F.count("*").cast("double").alias("_n"), F.avg(size).alias("_mean"), F.var_pop(size).alias("_var"))
    slope = F.when(F.col("_var") > 0, (F.col("_words") - F.col("_docs") * F.col("_mean")) / (F.col("_n") * F.col("_var"))).otherwise(F.lit(0.0))
    fix = saved(moments.join(missed, ["_null", "_source"]).select("_null", "_source", (F.col("_docs") / F.col("_n")).alias("_shift"), slope.alias("_slope"), "_mean"))
    small = fix.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    tuned = others.join(F.broadcast(fix) if small else fix, ["_null", "_source"], "left")
    p = F.col("_p") + F.coalesce(F.col("_shift") + F.col("_slope") * (size - F.col("_mean")), F.lit(0.0))
    p = F.when(F.col("_p") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).otherwise(F.col("_p"))
    return settled, tuned.withColumn("_p", p).select(*names)


def _row_hash(names: list[str]) -> Column:
    return F.xxhash64(*map(column, dict.fromkeys(names)))


def mix_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
    more: list[str] = (),
) -> DataFrame:
    """Return (_id, _key, _source, size, source_size, target, copies, _times) for each row of `docs`.

    `copies` is how often the mix takes the document and `copies * size` its
    words.  `_key` hashes the columns id, text, source and those of `more`;
    rows that agree in it are copies of one document and are numbered by
    `_times`, so that they fall into different blocks.

    A null text has no words, a null source is a source of its own, and a null
    id is an id like others.  A very long text is one document, taken or not
    as a whole.  A source without words has the target 0.  Ties in size are
    decided by the hash.  The
    result depends on the rows and `seed` alone, not on their partitions.  An
    empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _ROW.format(id=id_type)
    one = docs.select(
        column(id_col).alias("_id"),
        _row_hash([id_col, text_col, source_col, *more]).alias("_hash"),
        column(source_col).isNull().alias("_null"),
        F.coalesce(column(source_col), F.lit("")).alias("_source"),
        word_count(column(text_col)).alias("_size"),
    )
    one = one.groupBy("_id", "_hash", "_null", "_source", "_size").agg(F.count("*").alias("_rows"))
    rows = saved(one)
    sources = rows.groupBy("_null", "_source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("source_size"))
    sources = saved(source_targets(sources, weights, max_repeat))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select("_id", "_hash", "_null", "_source", "_size", F.explode(F.expr("sequence(1L, _rows)")).alias("_times"))
    rows = _attach(rows, sources).select(
        "_id",
        F.xxhash64("_hash", "_times").alias("_key"),
        "_null",
        "_source",
        "_size",
        "_times",
        F.floor(rate).alias("_base"),
        (rate - F.floor(rate)).alias("_p"),
    )
    settled, open_rows = _decide_large(rows, sources, schema, seed)
    done = [settled]
    for level in range(64):
        moved = saved(_level(open_rows, schema, seed, level, block_rows))
        done.append(moved.where("_p in (0, 1)"))
        open_rows = moved.where("_p not in (0, 1)")
        if open_rows.isEmpty():
            break
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    out = _attach(settled, sources)
    return out.select(
        "_id",
        "_key",
        F.when(~F.col("_null"), F.col("_source")).alias("_source"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_base") + F.col("_p").cast("long")).alias("copies"),
        "_times",
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    names = docs.columns
    copies = mix_copies(docs, id_col, text_col, source_col, more=names, **options).where("copies > 0")
    hashed = _row_hash([id_col, text_col, source_col, *names])
    rows = docs.select(F.struct(*map(column, names)).alias("_row"), hashed.alias("_hash"))
    # Rows that agree in every column are interchangeable: one of them stands for all, numbered as above.
    taken = copies.groupBy("_key").agg(F.sum("copies").alias("_copies"))
    numbered = rows.groupBy("_hash").agg(F.first("_row").alias("_row"), F.count("*").alias("_rows"))
    numbered = numbered.withColumn("_key", F.explode(F.transform(F.expr("sequence(1L, _rows)"), lambda k: F.xxhash64("_hash", k))))
    return numbered.join(taken, "_key").select("_row", F.explode(F.expr("sequence(1L, _copies)")).alias("_n")).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
