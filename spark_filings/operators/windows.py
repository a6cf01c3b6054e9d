"""Long documents as overlapping windows, and the windows that questions need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import coverage, semantic_units, split_passages

WINDOW, CARRY = 16_000, 600


def _pack(passages: list[str], size: int, carry: int) -> Iterator[str]:
    held = ""
    for passage in passages:
        # A passage longer than a window has no ends in it and is cut to size.
        for piece in (passage[k : k + size] for k in range(0, len(passage), size)):
            if held and len(held) + len(piece) > size:
                yield held
                held = held[-carry:]
            held += piece
    if held.strip():
        yield held


def window_documents(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW, carry: int = CARRY) -> DataFrame:
    """(id_col, index, total, window): documents packed from whole passages into windows of about `size` characters.

    A document that fits is its own window, as it is; a null or empty one has
    one empty window.  Each other window begins with the last `carry`
    characters of the one before.
    """
    own = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("id", own), ("index", pa.int64()), ("total", pa.int64()), ("window", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (passages, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                windows = [text] if text is not None else list(_pack(passages, size, carry))
                n = len(windows)
                key = pa.repeat(batch.column(0)[i], n).cast(own)
                yield pa.RecordBatch.from_arrays([key, pa.array(range(1, n + 1), pa.int64()), pa.array([n] * n, pa.int64()), pa.array(windows, pa.string())], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    fits = F.length(text) <= size
    rows = docs.select(F.col(id_col).alias("id"), F.when(~fits, split_passages(text)).alias("passages"), F.when(fits, text).alias("whole"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, index long, total long, window string").withColumnRenamed("id", id_col)


def select_windows(windows: DataFrame, id_col: str, focus: DataFrame, k: int) -> DataFrame:
    """Of each document its first window and the k - 1 others that cover most of one of the questions (question); all if there are no more than k.

    Ties go to the earlier window.  The questions are few and broadcast; each
    window keeps the best of its coverages only.
    """
    asked = focus.agg(F.collect_list(semantic_units(F.col("question"))).alias("asked"))
    held = windows.withColumn("units", semantic_units(F.col("window"))).crossJoin(F.broadcast(asked))
    best = F.coalesce(F.array_max(F.transform("asked", lambda q: coverage(q, F.col("units")))), F.lit(0.0))
    ranked = held.withColumn("score", F.when(F.col("index") == 1, F.lit(2.0)).otherwise(best)).drop("units", "asked")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "index"))
    return ranked.withColumn("place", place).where((F.col("place") <= F.greatest(F.lit(k), F.lit(1))) | (F.col("total") <= k)).drop("place")
