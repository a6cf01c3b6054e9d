"""Line dedup: a deletion-neighbourhood join of lines within one edit.

A line goes if an earlier one is equal to it, or at an edit distance of one
where that is no more than a given share of the longer line.  Two lines are
that near if and only if they agree after one character at the same place is
taken out of both (substitution), or one of them after a character is taken
out equals the other (insertion, deletion).  So every line emits the hashes of its variants with one character
deleted, equal hashes are joined by an aggregation that keeps the earliest
line of each, and the edit distance of the two lines is then verified.

Emitting all variants of all lines would multiply the corpus by the length of
its lines.  The same deletion neighbourhood on whole blocks comes first: a
line and its near line agree after the half that holds the edit is taken out,
and then after the eighth of that half is.  Only lines, and places in them,
that find a partner at the coarser step go on to the next; no near line is
lost by this, as each step is necessary for the last.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_LEAD, IS_SPACE, U64, PrimeHash, Slice, arrow_type, column, mix64, saved, slices, table

#: The share of the longer line, in percent, that an edit may be: at 5, one
#: code point in 20.  100 lets any two lines that one edit parts be near.
EDIT_PERCENT = 5.0

#: Blocks into which a half is cut.
BLOCKS = 8

_HASH = "struct<x:long,y:long>"


def _line_bounds(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number of each line of each row; every row has at least one."""
    breaks = np.flatnonzero(piece.data == 10)
    owner = piece.row_of(breaks)
    rows = np.arange(piece.rows)
    starts, start_rows = np.concatenate([piece.offsets[:-1], breaks + 1]), np.concatenate([rows, owner])
    ends, end_rows = np.concatenate([breaks, piece.offsets[1:]]), np.concatenate([owner, rows])
    order = np.lexsort((starts, start_rows))
    starts, row = starts[order], start_rows[order]
    ends = ends[np.lexsort((ends, end_rows))]
    n = np.bincount(row, minlength=piece.rows)
    return starts, ends, row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


class Cutter:
    """Hashes of lines with a stretch of code points taken out."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.hashes = PrimeHash(data)
        lead = np.flatnonzero(IS_LEAD[data])
        self.at = np.concatenate([lead, [len(data)]])
        self.first = np.searchsorted(lead, starts)
        self.size = np.searchsorted(lead, ends) - self.first
        self.starts, self.ends = starts, ends

    def span(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of code points a to b of each `line`."""
        return self.hashes.span(self._byte(line, a), self._byte(line, b))

    def without(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of each `line` without its code points a to b."""
        return self.hashes.without(self.starts[line], self._byte(line, a), self._byte(line, b), self.ends[line])

    def _byte(self, line: np.ndarray, k: np.ndarray) -> np.ndarray:
        # The place after a line's last code point is its end, not the next line's start.
        return np.minimum(self.at[self.first[line] + k], self.ends[line])


def _key(hashes: np.ndarray, *parts) -> np.ndarray:
    for seed, p in enumerate(parts, 41):
        hashes = mix64(hashes, seed) + np.asarray(p).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix64(hashes, 40)


def _digests(piece: Slice, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128 bits of BLAKE2b of each line; they stand for its content."""
    whole = memoryview(np.ascontiguousarray(piece.data))
    raw = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "y"])


def _lines(least: int) -> Callable:
    """Each line that has a word, with its digest and the keys of its halves.

    Keys come in the order: without the second half, without the first half,
    and the same as the longer line of an insertion.  A pair is near only if
    the longer line has `least` code points.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _lines_of(batch, least)

    return run


def _lines_of(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        for piece in slices(batch.column(2)):
            starts, ends, row, number = _line_bounds(piece)
            solid = np.concatenate([[0], np.cumsum(~IS_SPACE[piece.data])])
            keep = solid[ends] > solid[starts]
            starts, ends, row, number = starts[keep], ends[keep], row[keep], number[keep]
            cut = Cutter(piece.data, starts, ends)
            line, zero = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
            keys = np.empty((len(line), 4), dtype=U64)
            for k, longer in ((0, 0), (2, 1)):
                size = np.maximum(cut.size - longer, 0)
                half = size // 2
                keys[:, k] = _key(cut.span(line, zero, half), size, 1)
                keys[:, k + 1] = _key(cut.span(line, np.minimum(half + longer, cut.size), cut.size), size, 2)
            # The longer line of an insertion and both of a substitution have the least size; the shorter may have one less.
            asks = np.repeat((cut.size >= least)[:, None], 4, axis=1)
            asks[:, :2] |= (cut.size >= least - 1)[:, None]
            offsets = np.concatenate([[0], np.cumsum(asks.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(piece.first, piece.rows).take(pa.array(row)),
                    batch.column(1).slice(piece.first, piece.rows).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    _digests(piece, starts, ends),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[asks].view(np.int64))),
                ],
                names=["_id", "_tie", "_line", "h", "keys"],
            )


def _take_lines(schema: pa.Schema):
    """(at, h, half, line text) from rows (text, [(at, h, half)]) of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                out = []
                for text, wanted in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    lines = text.split("\n")
                    out += [w | {"line": lines[w["at"]["_line"]]} for w in wanted]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _rows(batch: pa.RecordBatch, piece: Slice, line: np.ndarray, **columns) -> pa.RecordBatch:
    own = [batch.column(c).slice(piece.first, piece.rows).take(pa.array(line)) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(v) for v in columns.values())], names=["h", "at", *columns])


def _block_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h, at, half, line): keys of the line without each block of its halves that may hold the edit."""
    for batch in batches:
        for piece in slices(batch.column(3)):
            cut = Cutter(piece.data, piece.offsets[:-1], piece.offsets[1:])
            half = batch.column(2).slice(piece.first, piece.rows).to_numpy()
            for bit in (1, 2):
                for longer in (0, 1):
                    line = np.repeat(np.flatnonzero(half & bit), BLOCKS)
                    j = np.tile(np.arange(BLOCKS), len(line) // BLOCKS)
                    size = cut.size[line] - longer
                    lo, hi = (size // 2, size) if bit == 1 else (np.zeros_like(size), size // 2)
                    a, b = lo + (hi - lo) * j // BLOCKS, lo + (hi - lo) * (j + 1) // BLOCKS
                    key = _key(cut.without(line, a, b + longer), size, 2 * j + bit - 1)
                    kind = np.full(len(line), longer, dtype=np.int32)
                    yield _rows(batch, piece, line, key=key.view(np.int64), longer=kind, a=a.astype(np.int32), b=b.astype(np.int32))


def _character_keys(least: int) -> Callable:
    """From (h, at, blocks, line): keys of the line's variants.

    role 0: a character at a place taken out, with the place; role 1: the
    whole line; role 2: a character taken out, without the place.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _variants(batch, least)

    return run


def _variants(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        for piece in slices(batch.column(3)):
            cut = Cutter(piece.data, piece.offsets[:-1], piece.offsets[1:])
            line, longer, a, b = [], [], [], []
            for i, blocks in enumerate(batch.column(2).slice(piece.first, piece.rows).to_pylist()):
                for x in blocks:
                    line.append(i), longer.append(x["longer"]), a.append(x["a"]), b.append(x["b"] + x["longer"])
            line, longer, a, b = (np.array(x, dtype=np.int64) for x in (line, longer, a, b))
            for role in (0, 2):
                at = np.flatnonzero((longer == role // 2) & (cut.size[line] >= least))
                n = b[at] - a[at]
                each = np.repeat(at, n)
                p = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                own = line[each]
                hashes = cut.without(own, p, p + 1)
                key = _key(hashes, cut.size[own], p + 1) if role == 0 else _key(hashes, cut.size[own] - 1, 0)
                yield _rows(batch, piece, own, key=key.view(np.int64), role=np.full(len(own), role, dtype=np.int32))
            own = np.unique(line[longer == 0])
            key = _key(cut.span(own, np.zeros_like(own), cut.size[own]), cut.size[own], 0)
            yield _rows(batch, piece, own, key=key.view(np.int64), role=np.full(len(own), 1, dtype=np.int32))


def within_one_edit(x: str, y: str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one_edit(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield batch.select([0]).filter(pa.array(keep, pa.bool_()))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another line has as well.

    The least and the greatest line of a key are taken before the shuffle, so
    a key that very many lines share costs little; the join may be split.
    """
    keys = rows.groupBy("key").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi")).where("_lo <> _hi").select("key")
    return rows.join(keys, "key")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_percent: float = EDIT_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): every line with a word, and those that go with the reason.

    Both have (_id, _tie, _line); `removed` also has `near`, false for a line
    equal to an earlier one.
    """
    least = max(1, math.ceil(100 / edit_percent))
    kind = docs.schema[id_col].dataType.simpleString()
    at_type = f"struct<_null:boolean,_id:{kind},_tie:long,_line:int>"
    rows = docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col), F.lit("")).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    lines = rows.select("_id", "_tie", "_text").mapInArrow(_lines(least), f"_id {kind}, _tie long, _line int, h {_HASH}, keys array<long>")
    at = F.struct(F.col("_id").isNull().alias("_null"), "_id", "_tie", "_line")
    lines = saved(lines)
    first = saved(lines.groupBy("h").agg(F.min(at).alias("at"), F.count("*").alias("n")))

    # This step goes by half of a line's hash: it only proposes, and so does a chance agreement.
    halves = lines.select(F.col("h.x").alias("h"), F.posexplode("keys").alias("place", "key"))
    halves = halves.withColumn("half", (F.col("place") % 2 + 1).cast("byte")).drop("place")
    found = _shared(halves).groupBy(F.col("h").alias("x")).agg(F.bit_or("half").cast("int").alias("half"))
    wanted = found.join(first.withColumn("x", F.col("h.x")), "x").select("at", "h", "half")
    by_doc = wanted.groupBy(F.col("at._id").alias("_wid"), F.col("at._tie").alias("_wtie")).agg(F.collect_list(F.struct("at", "h", "half")).alias("wanted"))
    same = F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_tie") == F.col("_wtie"))
    taken = rows.join(by_doc, same).select("_text", "wanted")
    line_type = f"at {at_type}, h {_HASH}, half int, line string"
    at_arrow = pa.struct([("_null", pa.bool_()), ("_id", arrow_type(docs, id_col)), ("_tie", pa.int64()), ("_line", pa.int32())])
    h_arrow = pa.struct([("x", pa.int64()), ("y", pa.int64())])
    arrow = pa.schema([("at", at_arrow), ("h", h_arrow), ("half", pa.int32()), ("line", pa.string())])
    # Repeated rows give the same line more than once; one of them is enough.
    texts = saved(taken.mapInArrow(_take_lines(arrow), line_type).groupBy("h").agg(F.first("at").alias("at"), F.first("half").alias("half"), F.first("line").alias("line")))

    blocks = texts.select("h", "at", "half", "line").mapInArrow(_block_keys, f"h {_HASH}, at {at_type}, key long, longer int, a int, b int")
    matched = _shared(blocks.select("h", "key", "longer", "a", "b")).groupBy("h").agg(F.collect_set(F.struct("longer", "a", "b")).alias("blocks"))
    variants = texts.join(matched, "h").select("h", "at", "blocks", "line").mapInArrow(_character_keys(least), f"h {_HASH}, at {at_type}, key long, role int")
    variants = saved(variants)
    earliest = variants.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, F.struct("at", "h"))).alias(f"m{r}") for r in (0, 1, 2)))
    other = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    links = variants.join(earliest, "key").withColumn("other", other).where("other.at < at").groupBy("h").agg(F.min("other").alias("other"))
    x = texts.select("h", F.col("line").alias("x"))
    y = texts.select(F.col("h").alias("g"), F.col("line").alias("y"))
    near = links.select("h", F.col("other.h").alias("g")).join(x, "h").join(y, "g").select("h", "x", "y").mapInArrow(_verified, f"h {_HASH}")

    judged = first.join(near.withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near")
    judged = judged.select("h", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    lines = lines.withColumn("at", at)
    gone = lines.join(judged, "h").where("near or at <> first").select("_id", "_tie", "_line", (F.col("near") & (F.col("at") == F.col("first"))).alias("near"))
    return lines, gone


def judged_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_percent: float = EDIT_PERCENT) -> DataFrame:
    """(row, n_lines, n_removed, n_near): each row of `docs` as a struct, with `text_col` freed of removed lines.

    The counts are of lines with a word, of those removed, and of those of
    them that only an edit parts from an earlier one.  See `dedup_lines`.
    """
    _, gone = removed_lines(docs, id_col, text_col, edit_percent)
    # A line that repeated rows share occurs once for each of them.
    by_doc = gone.groupBy(F.col("_id").alias("_gid"), F.col("_tie").alias("_gtie")).agg(
        F.collect_set("_line").alias("_gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("_line")))).alias("_near")
    )
    # The text is shuffled once, not in the struct as well.
    rest = [column(n) for n in docs.columns if n != text_col]
    row = F.struct(*rest) if rest else F.struct(F.lit(0))
    rows = docs.select(row.alias("_row"), column(id_col).alias("_id"), column(text_col).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64(F.coalesce("_text", F.lit(""))))
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_tie") == F.col("_gtie"))
    lines = F.split("_text", "\n")
    kept = F.array_except(F.expr("sequence(0, size(_lines) - 1)"), F.col("_gone"))
    text = F.when(F.col("_gone").isNull() | F.col("_text").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    out = rows.join(by_doc, same, "left").withColumn("_lines", lines).withColumn("_kept", text)
    count = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    fields = [F.col("_kept").alias(n) if n == text_col else F.col("_row")[n].alias(n) for n in docs.columns]
    return out.select(
        F.struct(*fields).alias("row"),
        F.greatest(count, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_percent: float = EDIT_PERCENT, drop_bare: bool = False) -> DataFrame:
    """`docs` with `text_col` freed of removed lines; with `drop_bare`, without rows that are left without a word.

    Lines are cut at `\\n`.  One without a word always stays.  A line with a
    word goes if it equals one that comes earlier by (id, hash of the text,
    line number), or if one edit (a code point inserted, deleted or replaced)
    parts it from an earlier one and 100 / `edit_percent` is no more than the
    code points of the longer of the two.  What is earlier is judged on the
    input, not on what is left; ties in all of it are one document.

    A null text stays null and counts as empty.  A null id comes last.
    Repeated rows are one document: its copies lose the same lines and none
    to each other.  Texts and lines of any length are taken whole.  All
    columns are kept, whatever their names.  An empty table gives an empty
    result.
    """
    out = judged_lines(docs, id_col, text_col, edit_percent)
    return (out.where("n_removed < n_lines") if drop_bare else out).select("row.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        "n_lines",
        "n_removed",
        "n_near",
        F.length("row.text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"),
    )


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
