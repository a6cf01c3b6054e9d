"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk where its value meets
the trigger of a block size; each chunk gives one character of a signature.
Triggers are nested: those of a block size are among those of half of it.  A
text takes the smallest block size that gives at most 64 chunks, and its
fingerprint holds the signatures at that size and the next two, so that
fingerprints of texts of different lengths share a block size.  Likeness is
the best agreement by edit distance at a block size that both have.

Rolling hashes, chunk hashes and edit distances are computed for many texts at
once with numpy; whole texts are hashed, never prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, SLICE_BYTES, U64, arrow_type, column, mix64, prefix_hash, saved, span_hash, table

WINDOW = 7
LONGEST = 64
LEVELS = 3
SMALLEST_BLOCK = 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_DEEPEST = 44


class Signatures:
    """Signatures of n texts: `block[i]` is the exponent of the block size, `codes[l][i, :length[l][i]]` level l."""

    def __init__(self, block: np.ndarray, codes: list[np.ndarray], length: list[np.ndarray]) -> None:
        self.block, self.codes, self.length = block, codes, length

    def text(self, i: int) -> str:
        parts = [ALPHABET[c[i, : n[i]]].tobytes().decode() for c, n in zip(self.codes, self.length)]
        return ":".join([str(SMALLEST_BLOCK << int(self.block[i])), *parts])

    def part(self, at: slice) -> Signatures:
        return Signatures(self.block[at], [c[at] for c in self.codes], [n[at] for n in self.length])


def signatures(raw: list[bytes]) -> Signatures:
    """Signatures of whole texts given as UTF-8."""
    rows = len(raw)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    row = np.repeat(np.arange(rows), np.diff(offsets))
    prefix = prefix_hash(BYTE_VALUE[data])
    end = np.arange(1, len(data) + 1)
    rolling = mix64(span_hash(prefix, np.maximum(end - WINDOW, offsets[row]), end))
    third = np.flatnonzero(rolling % U64(SMALLEST_BLOCK) == U64(SMALLEST_BLOCK - 1))
    quotient = rolling[third] // U64(SMALLEST_BLOCK)
    # Trailing ones of the quotient: how often the block size may double and still trigger here.
    lowest_zero = ~quotient & (quotient + U64(1))
    depth = np.minimum(np.log2(np.maximum(lowest_zero, U64(1)).astype(np.float64)).astype(np.int64), _DEEPEST - 1)
    at = row[third]
    counts = np.bincount(at * _DEEPEST + depth, minlength=rows * _DEEPEST).reshape(rows, _DEEPEST)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    block = np.argmax(counts < LONGEST, axis=1)
    codes, lengths = [], []
    for level in range(LEVELS):
        hit = depth >= block[at] + level
        ends, owner = third[hit] + 1, at[hit]
        # The rest of a text after its last trigger is a chunk as well.
        last = offsets[:-1].copy()
        np.maximum.at(last, owner, ends)
        tail = np.flatnonzero(last < offsets[1:])
        ends, owner = np.concatenate([ends, offsets[1:][tail]]), np.concatenate([owner, tail])
        order = np.lexsort((ends, owner))
        ends, owner = ends[order], owner[order]
        starts = np.concatenate([[0], ends[:-1]])
        if len(ends):
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            starts[first] = offsets[owner[first]]
        code = (mix64(span_hash(prefix, starts, ends), 5) >> U64(58)).astype(np.uint8)
        length = np.bincount(owner, minlength=rows)
        place = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
        grid = np.zeros((rows, LONGEST), dtype=np.uint8)
        grid[owner, place] = code
        codes.append(grid)
        lengths.append(length)
    return Signatures(block, codes, lengths)


def edit_distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of `a` (lengths n) and `b` (lengths m), up to 64 symbols each.

    Bit-parallel: a 64-bit word of each pair holds the vertical differences of
    a column of its table.
    """
    out = np.maximum(n, m).astype(np.int64)
    live = np.flatnonzero((n > 0) & (m > 0))
    if not len(live):
        return out
    a, n, b, m = a[live], n[live], b[live], m[live]
    inside = np.arange(LONGEST) < n[:, None]
    plus, minus = np.full(len(live), ~U64(0)), np.zeros(len(live), dtype=U64)
    score = n.astype(np.int64)
    top = U64(1) << (n - 1).astype(U64)
    for j in range(int(m.max())):
        same = np.packbits((a == b[:, j, None]) & inside, axis=1, bitorder="little").view(U64)[:, 0]
        x = same | minus
        h = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(h | plus)
        down = plus & h
        on = j < m
        score += np.where(on, ((up & top) != 0).astype(np.int64) - ((down & top) != 0), 0)
        up = (up << U64(1)) | U64(1)
        down = down << U64(1)
        plus, minus = down | ~(x | up), up & x
    out[live] = score
    return out


def likeness(a: Signatures, b: Signatures) -> np.ndarray:
    """0 to 1 for each pair; 0 if they have no block size in common."""
    best = np.zeros(len(a.block))
    for i in range(LEVELS):
        for j in range(LEVELS):
            both = np.flatnonzero(a.block + i == b.block + j)
            if len(both):
                n, m = a.length[i][both], b.length[j][both]
                d = edit_distances(a.codes[i][both], n, b.codes[j][both], m)
                longest = np.maximum(n, m)
                best[both] = np.maximum(best[both], np.where(longest > 0, 1 - d / np.maximum(longest, 1), 1.0))
    return best


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema(
    [
        ("_part", pa.int32()),
        ("_kind", pa.string()),
        ("_id", pa.string()),
        ("_text", pa.string()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_DDL = "_part int, _kind string, _id {id}, _text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """The columns of some texts, each with the one that follows it."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    n = len(texts)
    # Each next document is this list's next text, but for the last one.
    own = signatures([t.encode() for t in (*texts, following[-1])])
    other = signatures(changed)
    here, after = own.part(slice(0, n)), own.part(slice(1, n + 1))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
        "fingerprint": [own.text(i) for i in range(n)],
        "edited_fingerprint": [other.text(i) for i in range(n)],
        "near_edited": likeness(here, other),
        "near_next": likeness(here, after),
    }


def _walk(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            empty = {f.name: pa.nulls(1, f.type) for f in schema}
            return pa.RecordBatch.from_pydict(
                empty | {"_part": pa.array([part], pa.int32()), "_kind": pa.array([kind]), "_id": pa.array([row[0]], schema.field("_id").type), "_text": pa.array([row[1]])}, schema=schema
            )

        def flush(held: list[tuple], following: str) -> pa.RecordBatch:
            n = len(held)
            out = {"_part": pa.array([part] * n, pa.int32()), "_kind": pa.array(["row"] * n), "_id": pa.array([h[0] for h in held], schema.field("_id").type), "_text": pa.nulls(n, pa.string())}
            out |= _compare([h[1] for h in held], [*(h[1] for h in held[1:]), following])
            return pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

        held, size, seen = [], 0, False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for row in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if not seen:
                        yield edge("head", row)
                        seen = True
                    if size >= SLICE_BYTES:
                        yield flush(held, row[1])
                        held, size = [], 0
                    held.append(row)
                    size += len(row[1])
        if held:
            if len(held) > 1:
                yield flush(held[:-1], held[-1][1])
            yield edge("open", held[-1])

    return run


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are dealt over ranges of their id and compared with the next one
    while a range streams by.  The last document of a range waits for the
    first of the next one; those few are compared at the end, and the last of
    all with the first of all.

    A null text is empty.  A null id comes last.  Documents with the same id
    (ties) follow each other by a hash of their text, and equal rows in any
    order.  Very long texts are fingerprinted whole, and by 64 symbols at most
    at each block size.  A
    table of one document is followed by itself.  Two empty fingerprints are
    alike (1), an empty and another are not (0).  Other columns are ignored;
    an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text")).withColumn("_n", F.monotonically_increasing_id())
    order = [F.col("_id").isNull(), F.col("_id"), F.col("_tie"), F.col("_n")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    schema = _OUT.set(2, pa.field("_id", arrow_type(docs, id_col)))
    ddl = _DDL.format(id=kind.simpleString())
    walked = saved(dealt.mapInArrow(_walk(schema), ddl))

    # Two rows for each partition: an open document and the head of the next partition that has one.
    ends = sorted((r[0], r[1]) for r in walked.where("_kind <> 'row'").select("_part", "_kind").collect())
    parts = [p for p, k in ends if k == "head"]
    if not parts:
        return walked.select(F.col("_id").alias(id_col), *_OUT.names[4:])
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "_part int, _next int")
    heads = walked.where("_kind = 'head'").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))
    last = walked.where("_kind = 'open'").select("_part", "_id", "_text").join(F.broadcast(pairs), "_part").join(heads, "_next")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                out = _compare(one.column(1).to_pylist(), one.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([one.column(0), *(pa.array(out[f.name], f.type) for f in list(schema)[4:])], schema=pa.schema([schema.field("_id"), *list(schema)[4:]]))

    columns = ddl.split(", ")
    closed = last.select("_id", "_text", "_following").mapInArrow(close, ", ".join([columns[2], *columns[4:]]))
    return walked.where("_kind = 'row'").select("_id", *_OUT.names[4:]).unionByName(closed).withColumnRenamed("_id", id_col)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprint": op1_fingerprint}
ORACLES: dict[str, str] = {}
