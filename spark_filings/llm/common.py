"""Helpers that the operators of this subpackage share.

Texts reach Python as Arrow batches and are handled as one byte array per
slice, so that splitting, hashing and counting are numpy operations over many
documents at once.  A slice is bounded in bytes (one very long text may exceed
it alone), which bounds the memory of a task whatever the batch holds.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of code points outside this ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SLICE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

#: Marks the first byte of each UTF-8 code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = np.atleast_1d(np.asarray(x, dtype=U64)) + U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257), 77)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(n, base, dtype=U64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=U64))


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = base**a * H(values[a:b]), for `span_hash`.

    Good for choosing places and proposing candidates only: modulo a power of
    two, texts can be made that differ and agree in this hash.  Where a hash
    stands for its content, `hash_spans` or `PrimeHash` is used.
    """
    POWERS.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * POWERS.up[: len(values)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that depend on their contents alone (not yet mixed)."""
    return (prefix[end] - prefix[start]) * POWERS.down[start]


#: Spans of more bytes are digested one by one.
_LONG_SPAN = 1024
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, eight bytes at a time through a mixer; no algebra relates them."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    out = mix64(left.astype(U64), 5) if len(left) else np.zeros(0, dtype=U64)
    for k in np.flatnonzero(left > _LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    at = np.flatnonzero(left <= _LONG_SPAN)
    starts, left = starts[at], left[at]
    while len(at):
        x = (out[at] ^ (eight[starts] & _LOW_BYTES[np.minimum(left, 8)])) * U64(0xD6E8FEB86659FD93)
        out[at] = (x ^ (x >> U64(32))) * U64(0x9E3779B97F4A7C15)
        more = left > 8
        at, starts, left = at[more], starts[more] + 8, left[more] - 8
    return mix64(out, 3) if len(out) else out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether spans have the same bytes as others, eight bytes at a time."""
    equal = ends - starts == other_ends - other_starts
    at = np.flatnonzero(equal & (starts != other_starts))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    a, b, left = starts[at], other_starts[at], (ends - starts)[at]
    while len(at):
        differs = ((eight[a] ^ eight[b]) & _LOW_BYTES[np.minimum(left, 8)]) != 0
        equal[at[differs]] = False
        on = ~differs & (left > 8)
        at, a, b, left = at[on], a[on] + 8, b[on] + 8, left[on] - 8
    return equal


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each span's content (equal contents, equal numbers), and one span of each number.

    Contents meet by hash and are then compared byte by byte, so numbers are
    exact.
    """
    _, one, same = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    other = one[same]
    equal = equal_spans(data, starts, ends, starts[other], ends[other])
    if equal.all():
        return same, one
    # Two contents under one hash: number all of them by their bytes.
    numbers: dict[bytes, int] = {}
    same = np.array([numbers.setdefault(data[s:e].tobytes(), len(numbers)) for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
    return same, np.unique(same, return_index=True)[1]


_P = U64((1 << 31) - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo the prime 2**31 - 1."""
    x = (x & _P) + (x >> U64(31))
    x = (x & _P) + (x >> U64(31))
    return np.where(x >= _P, x - _P, x)


class PrimeHash:
    """Hashes of spans of some bytes, and of spans with a gap: polynomials modulo a prime at two unrelated bases.

    Both residues together have 62 bits.
    """

    BASES = (0x3A7F1C95, 0x51E2B6D3)
    VALUES = tuple(_mod(mix64(np.arange(1, 257), 81 + k) >> U64(2)) for k in range(2))

    def __init__(self, data: np.ndarray) -> None:
        self.powers = [self._power(b, len(data) + 1) for b in self.BASES]
        inverses = [pow(b, -1, int(_P)) for b in self.BASES]
        self.down = [self._power(b, len(data) + 1) for b in inverses]
        self.prefix = []
        for values, up in zip(self.VALUES, self.powers):
            total = np.zeros(len(data) + 1, dtype=U64)
            np.cumsum(_mod(values[data] * up[: len(data)]), dtype=U64, out=total[1:])
            self.prefix.append(total)

    _known: dict[int, np.ndarray] = {}

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        held = cls._known.get(base, np.ones(1, dtype=U64))
        while len(held) < n:
            held = np.concatenate([held, _mod(held * U64(pow(base, len(held), int(_P))))])
        cls._known[base] = held
        return held

    def _parts(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        return [_mod(_mod(p[ends] - p[starts]) * d[starts]) for p, d in zip(self.prefix, self.down)]

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x, y = self._parts(starts, ends)
        return (x << U64(31)) | y

    def without(self, starts: np.ndarray, gap: np.ndarray, after: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from `starts` to `gap` followed by those from `after` to `ends`."""
        head, tail = self._parts(starts, gap), self._parts(after, ends)
        x, y = (_mod(h + _mod(t * up[gap - starts])) for h, t, up in zip(head, tail, self.powers))
        return (x << U64(31)) | y


class Slice:
    """Some consecutive texts of a batch as one byte array."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes marked `inside`; a run never crosses rows."""
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the row of each word; a word never crosses rows."""
        starts, ends = self.runs(~IS_SPACE[self.data])
        return starts, ends, self.row_of(starts)

    def word_hashes(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each word (A-Z lowered if asked) and its row."""
        starts, ends, rows = self.words()
        return hash_spans(TO_LOWER[self.data] if lower else self.data, starts, ends), rows


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a batch in slices of about `limit` bytes."""
    n = len(column)
    if not n:
        return
    data, offsets = strings(column)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Slice(first, data[lo:hi], (offsets[first : last + 1] - lo).astype(np.int64))
        first = last


def small_batches(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column with exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


#: Largest order key: a null id comes after all others.
LAST = (1 << 63) - 1


def order_keys(docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` (its id and other columns not named _key) with a long _key that orders as the id does; null comes last."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn("_key", F.coalesce(column(id_col).cast("long"), F.lit(LAST)))
    ids = docs.select(column(id_col).alias("_of")).where("_of is not null").distinct().orderBy("_of")
    # Sorted partitions are numbered in order, and rows within them.
    ids = saved(ids.withColumn("_key", F.monotonically_increasing_id()))
    out = docs.drop("_key").join(ids, column(id_col) == F.col("_of"), "left").drop("_of")
    return out.withColumn("_key", F.coalesce("_key", F.lit(LAST)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir of the session.

    Only where it is unset on a single machine (as in tests) a temporary one
    is made; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def discard(spark: SparkSession, path: str) -> None:
    """Delete what is under a path, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting to delete a query's shuffle files when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage by a reliable checkpoint in the shared folder.

    Nothing reads the shuffle files that led to it once it is written, so
    Spark is asked to delete them with the query, by a setting that holds for
    this query only.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def compacted(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """`saved`, and read in as few partitions as hold about `rows` rows each.

    Small tables that are shuffled again then leave few small files, however
    many partitions they came from.
    """
    df = saved(df)
    return df.coalesce(max(1, math.ceil(df.count() / rows)))
