"""Suffix-array dedup: remove bytes of 50-byte strings that an earlier document has.

Equal strings must meet, wherever they stand.  Every 50-byte window has an
anchor: the least among the hashes of its 24-byte strings, the first of them.
Equal windows have equal anchors at equal places.  Consecutive windows with
one anchor make an entry, whose bytes are at most 26 before the anchor and 50
from it on.

1. An exchange of hashes tells which anchors another document has; windows
   with any other anchor are unique.  It only proposes.
2. Entries with shared anchors are dealt by anchor, with their bytes.  A task
   sends equal ones once: the phrases (text between anchors) of a block of its
   documents are sorted as one sequence by the linear grouping construction of
   its suffix array, where equal entries are neighbours.
3. Where the entries of an anchor meet, their bytes from the anchor on are
   packed into a few symbols each, and the linear grouping construction sorts
   the suffixes of all of them.  Bytes that neighbours in this order have in
   common give the entries that agree from the anchor to any depth; the
   entries that also agree before it, in the order of what stands before it,
   have windows in common, and the least document among them has them first.
   So each decision is by suffix order and bytes, none by a hash.

An anchor of very many documents (as in a passage that a third of them have)
is dealt by window instead, so that no group grows with the corpus.

Texts are shuffled once, where they meet the first answers; after that only
documents with shared anchors go on, compressed.  Copies of a whole document
are found by digest (SHA-256) and take no part, as the first of them has every
string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, LAST, U64, Slice, arrow_type, column, hash_spans, mix64, order_keys, prefix_hash, saved, slices, span_hash, table
from .gsaca import suffix_array

LENGTH = 50
K = 24
BEFORE = LENGTH - K
WINDOW = BEFORE + 1

#: Columns of an entry's bytes: those before the anchor, from its end on, and those from its start.
COLUMNS = BEFORE + LENGTH
_WIDE = COLUMNS + -COLUMNS % 8

#: Anchors, and entries, that a task packs at once.
PACK = 1_500_000
PACK_ENTRIES = 200_000

#: Bytes of text for each part of an exchange: so many up to MANY parts, and the second number beyond.
PART_BYTES = 16 << 20, 128 << 20
MANY = 2000

#: Documents whose answers travel together.
BUNDLE = 256

#: Bytes of text handled at once: the arrays of one step then stay in a core's cache.
STEP = 1 << 17

#: Phrases, and entries, that are sorted together (more entries only if they have one anchor).
BLOCK_PHRASES = 300_000
BLOCK_ENTRIES = 30_000

#: An anchor that is estimated to occur so often is dealt by window.  The
#: estimate only deals: results do not depend on it.
HOT = 100_000
#: Occurrences in the sample of documents that make an anchor hot.
HOT_SAMPLE = 200

_CODEC = pa.Codec("zstd", compression_level=1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each i, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """What the exchange of anchors compares: the part and 32 bits within it."""
    return (((hashes >> U64(32)) % U64(parts)) << U64(32)) | (hashes & U64(0xFFFFFFFF))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


class Anchors:
    """The anchors of the rows of a slice: place, row, hash, and the first and last start of their windows."""

    def __init__(self, piece: Slice) -> None:
        data, n = piece.data, len(piece.data)
        self.at = self.first = self.last = np.zeros(0, dtype=np.int64)
        if n >= LENGTH:
            i = np.arange(n - K + 1)
            # This hash chooses places only; the place itself decides between equal ones.
            hashes = mix64(span_hash(prefix_hash(BYTE_VALUE[data]), i, i + K))
            least = _sliding((hashes & U64(0xFFFFFFFF00000000)) | i.astype(U64), WINDOW, np.minimum)
            inside = np.ones(n, dtype=bool)
            for end in piece.offsets[1:].tolist():
                inside[max(0, end - LENGTH + 1) : end] = False
            windows = np.flatnonzero(inside[: len(least)])
            place = (least[windows] & U64(0xFFFFFFFF)).astype(np.int64)
            starts, count = _runs(place)
            self.at, self.first, self.last = place[starts], windows[starts], windows[starts + count - 1]
        self.hash = hash_spans(data, self.at, self.at + K) | U64(1)
        self.row = piece.row_of(self.at)


_PACKED = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("items", pa.binary()), ("shapes", pa.binary()), ("blob", pa.binary())])
_PACKED_DDL = "part int, ids binary, counts binary, items binary, shapes binary, blob binary"


def _packed(part: int, rank: np.ndarray, ids: np.ndarray, items: np.ndarray, shapes: np.ndarray | None = None, blob: bytes = b"") -> pa.RecordBatch:
    """Entries in the order of `rank`, their place in `ids`, as one row; ids travel as runs."""
    starts, counts = _runs(rank)
    row = [part, ids[rank[starts]].tobytes(), counts.astype(np.int32).tobytes(), items.tobytes(), b"" if shapes is None else shapes.tobytes(), blob]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED)], schema=_PACKED)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each one's place."""
    starts, n = _runs(ids)
    table, place = np.unique(ids[starts], return_inverse=True)
    return table, np.repeat(place.ravel(), n)


def _settled(ids: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Answers of a task to its own questions: they travel with the questions, in parts below 0."""
    for lo in range(0, len(ids), PACK):
        table, rank = _ranked(ids[lo : lo + PACK])
        order = np.argsort(rank, kind="stable")
        some = items[lo : lo + PACK][order]
        yield _packed(-1 - int(some[0] % U64(1 << 20)), rank[order], table, some)


def _zipped(values: np.ndarray) -> bytes:
    return values.nbytes.to_bytes(4, "little") + _CODEC.compress(np.ascontiguousarray(values), asbytes=True)


def _unzipped(held: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(held[4:], int.from_bytes(held[:4], "little"), asbytes=True), dtype=dtype)


class AnchorPacker:
    """Anchors of a task on their way to the parts of an exchange, which asks whether another document has them.

    What the task's own anchors settle is answered here; of each anchor only
    the earliest document goes out.
    """

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, items: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((items, ids))
        self.size += len(items)
        if self.size >= PACK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        items, ids = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        items = _keys(items, self.parts)
        table, rank = _ranked(ids)
        order = np.argsort(items)
        items, rank = items[order], rank[order]
        starts, n = _runs(items)
        first = np.minimum.reduceat(rank, starts)
        several = np.repeat(np.logical_or.reduceat(rank != np.repeat(first, n), starts), n)
        yield from _settled(table[rank[several]], items[several])
        items, part = items[starts], (items[starts] >> U64(32)).astype(np.int64)
        order = np.argsort((part << 32) | first)
        items, part, first = items[order], part[order], first[order]
        for lo, k in zip(*(x.tolist() for x in _runs(part))):
            yield _packed(int(part[lo]), first[lo : lo + k], table, items[lo : lo + k].astype(np.uint32))


#: How the windows of an entry lie: bytes before the anchor that the first one
#: has, the number of windows, and the bit of the first in the entry's answer.
_SHAPE = np.dtype([("left", "u1"), ("width", "u1"), ("bit", "u1")])


class Entries:
    """Entries as rows of `grid`: BEFORE bytes before the anchor, backwards, then LENGTH bytes from it on, 0 beyond."""

    def __init__(self, ids: np.ndarray, items: np.ndarray, shape: np.ndarray, grid: np.ndarray) -> None:
        self.ids, self.items, self.shape, self.grid = ids, items, shape, grid

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.ids[at], self.items[at], self.shape[at], self.grid[at])

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate(x) for x in zip(*((p.ids, p.items, p.shape, p.grid) for p in parts))))

    def right(self) -> np.ndarray:
        """Bytes from the anchor on that each entry has."""
        return LENGTH - self.shape["left"].astype(np.int64) + self.shape["width"] - 1

    def hashes(self, lo: int, hi: int) -> np.ndarray:
        return _grid_hash(self.grid[:, lo:hi])

    def windows(self) -> Entries:
        """One entry for each window."""
        width = self.shape["width"].astype(np.int64)
        of = np.repeat(np.arange(len(self)), width)
        k = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        out = self.take(of)
        out.shape["left"] -= k.astype(np.uint8)
        out.shape["bit"] += k.astype(np.uint8)
        out.shape["width"] = 1
        _trim(out.grid, out.shape["left"], out.right())
        return out


def _trim(grid: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    grid[:, :BEFORE][np.arange(BEFORE) >= left[:, None]] = 0
    grid[:, BEFORE:COLUMNS][np.arange(LENGTH) >= right[:, None]] = 0


def _grid_hash(grid: np.ndarray) -> np.ndarray:
    out = np.full(len(grid), 61, dtype=U64)
    for column in _eights(grid).T:
        out = (out ^ column) * U64(0xD6E8FEB86659FD93)
        out = (out ^ (out >> U64(32))) * U64(0x9E3779B97F4A7C15)
    return mix64(out, 61) if len(out) else out


def _items(grid: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """What an entry is called in the answers of its document."""
    return mix64(_grid_hash(grid) + shape["left"].astype(U64) * U64(64) + shape["width"].astype(U64), 63) if len(grid) else np.zeros(0, dtype=U64)


def _eights(grid: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian integers, which order alike."""
    n, width = grid.shape
    wide = np.zeros((n, width + -width % 8), dtype=np.uint8)
    wide[:, :width] = grid
    return wide.view(">u8").astype(U64)


def _places(grid: np.ndarray) -> np.ndarray:
    """The place of each row among the distinct rows in order of their bytes, from 0."""
    columns = _eights(grid)
    order = np.lexsort(columns.T[::-1])
    held = columns[order]
    out = np.zeros(len(grid), dtype=np.int64)
    out[order[1:]] = np.cumsum((held[1:] != held[:-1]).any(axis=1))
    return out


def _agreement(grid: np.ndarray) -> np.ndarray:
    """Bytes that each row of an ordered grid has in common with the one before it; 0 for the first."""
    out = np.zeros(len(grid), dtype=np.int64)
    differs = grid[1:] != grid[:-1]
    out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), grid.shape[1])
    return out


#: Columns from the anchor on that make a symbol: the anchor itself and two pieces of what follows.
_SYMBOLS = [(BEFORE, BEFORE + K), (BEFORE + K, BEFORE + K + BEFORE // 2), (BEFORE + K + BEFORE // 2, COLUMNS)]


def earlier_windows(some: Entries) -> np.ndarray:
    """For each entry, the windows (as bits) that an entry of a smaller id has as well."""
    n = len(some)
    masks = np.zeros(n, dtype=np.uint32)
    if n < 2:
        return masks
    # Each entry is its symbols and an end that is less than all of them.
    text = np.ones((n, len(_SYMBOLS) + 1), dtype=np.int64)
    base = 2
    for c, (lo, hi) in reversed(list(enumerate(_SYMBOLS))):
        text[:, c] = base + _places(some.grid[:, lo:hi])
        base = int(text[:, c].max()) + 1
    order = suffix_array(text.ravel())
    order = order[order % text.shape[1] == 0] // text.shape[1]
    agree = _agreement(some.grid[order, BEFORE:COLUMNS])
    before = np.lexsort(_eights(some.grid[:, :BEFORE]).T[::-1])
    agree_before = _agreement(some.grid[before, :BEFORE])
    left, width = some.shape["left"].astype(np.int64), some.shape["width"].astype(np.int64)
    follows, precedes = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for k in range(WINDOW):
        bit = left - k
        at = np.flatnonzero((bit >= 0) & (bit < width))
        if len(at) < 2:
            continue
        follows[order] = np.cumsum(agree < LENGTH - k)
        precedes[before] = np.cumsum(agree_before < k)
        key = precedes[at] * (n + 1) + follows[at]
        by = np.argsort(key)
        starts, count = _runs(key[by])
        ids = some.ids[at[by]]
        late = at[by[ids != np.repeat(np.minimum.reduceat(ids, starts), count)]]
        masks[late] |= np.uint32(1) << bit[late].astype(np.uint32)
    return masks


def _all_bits(shape: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << shape["width"].astype(U64)) - U64(1)).astype(np.uint32)


class EntryPacker:
    """Entries of a task on their way to the parts of an exchange, with their bytes.

    Items go along only where they do not follow from the bytes.
    """

    def __init__(self, parts: int, with_items: bool) -> None:
        self.parts, self.with_items = parts, with_items
        self.held: list[tuple[Entries, np.ndarray]] = []
        self.size = 0

    def add(self, some: Entries, route: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((some, route))
        self.size += len(some)
        if self.size >= PACK_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        some, route = Entries.joined([e for e, _ in self.held]), np.concatenate([r for _, r in self.held])
        self.held, self.size = [], 0
        part = ((route >> U64(32)) % U64(self.parts)).astype(np.int64)
        table, rank = _ranked(some.ids)
        order = np.argsort((part << 32) | rank)
        part, rank = part[order], rank[order]
        for lo, k in zip(*(x.tolist() for x in _runs(part))):
            own = some.take(order[lo : lo + k])
            has = np.concatenate([np.arange(BEFORE) < own.shape["left"][:, None], np.arange(LENGTH) < own.right()[:, None]], axis=1)
            raw = own.grid[:, :COLUMNS][has].tobytes()
            items = own.items if self.with_items else own.items[:0]
            yield _packed(int(part[lo]), rank[lo : lo + k], table, items, own.shape, _zipped(np.frombuffer(raw, dtype=np.uint8)))


def _ids(group: pa.Table) -> np.ndarray:
    raw = [b"".join(v.as_buffer() for v in group.column(c)) for c in ("ids", "counts")]
    return np.repeat(np.frombuffer(raw[0], dtype=np.int64), np.frombuffer(raw[1], dtype=np.int32))


def _unpacked(group: pa.Table) -> Iterator[Entries]:
    """The entries of each row of a part."""
    for i in range(group.num_rows):
        row = group.slice(i, 1)
        ids = _ids(row)
        items, shape = (np.frombuffer(row.column(c)[0].as_buffer(), dtype=t) for c, t in (("items", U64), ("shapes", _SHAPE)))
        some = Entries(ids, items, shape.copy(), np.zeros((len(ids), _WIDE), dtype=np.uint8))
        has = np.concatenate([np.arange(BEFORE) < shape["left"][:, None], np.arange(LENGTH) < some.right()[:, None]], axis=1)
        some.grid[:, :COLUMNS][has] = _unzipped(row.column("blob")[0].as_py(), np.uint8)
        if not len(items):
            some.items = _items(some.grid, some.shape)
        yield some


_BUNDLE = pa.schema([("bundle", pa.int64()), ("ids", pa.binary()), ("items", pa.binary()), ("masks", pa.binary())])
_BUNDLE_DDL = "bundle long, ids binary, items binary, masks binary"
_ANSWER = pa.schema([("id", pa.int64()), ("items", pa.binary()), ("masks", pa.binary())])
_ANSWER_DDL = "id long, items binary, masks binary"


def _bundles(ids: np.ndarray, items: np.ndarray, masks: np.ndarray | None, count: int) -> pa.Table:
    """Answers as a row for each bundle of documents."""
    bundle = (mix64(ids.view(U64), 67) % U64(count)).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)
    order = np.argsort(bundle)
    bundle, ids, items = bundle[order], ids[order], items[order]
    masks = np.zeros((len(ids), 0), dtype=np.uint32) if masks is None else masks[order]
    starts, n = _runs(bundle)
    cuts = [(lo, lo + k) for lo, k in zip(starts.tolist(), n.tolist())]
    packed = [pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for x in (ids, items, masks)]
    return pa.Table.from_arrays([pa.array(bundle[starts]), *packed], schema=_BUNDLE)


def _by_id(group: pa.Table) -> pa.Table:
    """A bundle's answers, a row for each document, with items in order."""
    raw = [b"".join(x.as_buffer() for x in group.column(c)) for c in ("ids", "items", "masks")]
    ids, items, masks = (np.frombuffer(r, dtype=t) for r, t in zip(raw, (np.int64, U64, np.uint32)))
    order = np.lexsort((items, ids))
    ids, items = ids[order], items[order]
    if len(ids):
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (items[1:] != items[:-1])]))
        masks = np.bitwise_or.reduceat(masks[order], new) if len(masks) else masks
        ids, items = ids[new], items[new]
    starts, n = _runs(ids)
    cuts = [(lo, lo + k) for lo, k in zip(starts.tolist(), n.tolist())]
    packed = [pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for x in (items, masks)]
    return pa.Table.from_arrays([pa.array(ids[starts]), *packed], schema=_ANSWER)


def _tell_anchors(count: int):
    """Which anchors of a part more than one document has."""

    def run(group: pa.Table) -> pa.Table:
        part, ids = group.column("part")[0].as_py(), _ids(group)
        items = np.frombuffer(b"".join(v.as_buffer() for v in group.column("items")), dtype=U64 if part < 0 else np.uint32).astype(U64)
        if part >= 0:
            items = items | U64(part << 32)
            order = np.argsort(items)
            ids, items = ids[order], items[order]
            starts, n = _runs(items)
            if len(starts):
                several = np.repeat(np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts), n)
                ids, items = ids[several], items[several]
        return _bundles(ids, items, None, count)

    return run


def _tell_windows(count: int):
    """Which windows of a part's entries an earlier document has."""

    def run(group: pa.Table) -> pa.Table:
        some = Entries.joined(list(_unpacked(group)))
        anchor = some.hashes(BEFORE, BEFORE + K)
        order = np.argsort(anchor)
        starts, n = _runs(anchor[order])
        masks = np.zeros(len(some), dtype=np.uint32)
        lo = 0
        for end in (starts + n).tolist():
            if end - lo >= BLOCK_ENTRIES or end == len(order):
                at = order[lo:end]
                masks[at] = earlier_windows(some.take(at))
                lo = end
        yes = masks > 0
        return _bundles(some.ids[yes], some.items[yes], masks[yes] << some.shape["bit"][yes].astype(np.uint32), count)

    return run


def _exchange(packed: DataFrame, tell, count: int) -> DataFrame:
    """(id, items, masks): every question's answer, gathered for each document by way of `count` bundles."""
    told = packed.groupBy("part").applyInArrow(lambda t: tell(t), _BUNDLE_DDL)
    return told.groupBy("bundle").applyInArrow(lambda t: _by_id(t), _ANSWER_DDL)


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `held`."""
    if not len(held):
        return np.zeros(len(values), dtype=bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _ask_anchors(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = AnchorPacker(parts)
        for batch in batches:
            for piece in slices(batch.column(1), STEP):
                found = Anchors(piece)
                key = batch.column(0).slice(piece.first, piece.rows).to_numpy()
                yield from packer.add(found.hash, key[found.row])
        yield from packer.flush()

    return run


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the anchors of some documents."""
    for batch in batches:
        for piece in slices(batch.column(0)):
            found = Anchors(piece)
            values, n = np.unique(found.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["h", "n"])


def _hot_anchors(rows: DataFrame) -> np.ndarray:
    """Hashes of the anchors that are estimated to occur HOT times or more, in order.

    They come from the documents of a sample by hash, one in HOT / HOT_SAMPLE,
    so there are at most as many as the text has anchors, over HOT / 2.
    """
    rate = max(1, HOT // HOT_SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("_key", F.lit(71)), F.lit(rate)) == 0).select("_text")
    least = max(2, HOT_SAMPLE // 2)
    found = some.mapInArrow(_anchor_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(U64))


_KEPT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("marks", pa.binary()), ("shape", pa.binary()), ("known", pa.binary())]
_KEPT_DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, marks binary, shape binary, known binary"


def _squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, digest, text) with the text compressed."""
    for batch in batches:
        for piece in slices(batch.column(3)):
            own = [batch.column(c).slice(piece.first, piece.rows) for c in (0, 1, 2)]
            blobs = [_CODEC.compress(piece.raw(i), asbytes=True) for i in range(piece.rows)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(piece.offsets)), pa.array(blobs, pa.binary())], names=["_id", "_key", "_digest", "n_bytes", "text"])


def _mark(parts: int, entry_parts: int, hot, schema: pa.Schema):
    """From (id, key, copy, shared anchors, size, text) two kinds of rows.

    Documents: the results of settled ones; the others compressed, with the
    places and shapes of their entries and the windows known so far.
    Questions: entries, for the second exchange.
    """

    def joined(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield joined(dict(zip(b.schema.names, b.columns)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(entry_parts, hot.value)
        for batch in batches:
            for at, piece in _texts(batch, 5, 4):
                found = Anchors(piece)
                bounds = np.searchsorted(found.row, np.arange(piece.rows + 1))
                texts = batch.column(5).slice(at, piece.rows).to_pylist()
                copies = batch.column(2).slice(at, piece.rows).to_pylist()
                answers = batch.column(3).slice(at, piece.rows).to_pylist()
                keys = _keys(found.hash, parts)
                shared = np.zeros(len(keys), dtype=bool)
                for i in range(piece.rows):
                    if answers[i] and not copies[i]:
                        part = slice(bounds[i], bounds[i + 1])
                        shared[part] = _among(keys[part], np.frombuffer(answers[i], dtype=U64))
                here = np.flatnonzero(shared)
                ids = batch.column(1).slice(at, piece.rows).to_numpy()
                some = _entries(piece, found, here, ids)
                cuts = np.searchsorted(found.row[here], np.arange(piece.rows + 1))
                out: dict[str, list] = {n: [] for n, _ in _KEPT}
                for i in range(piece.rows):
                    raw = piece.raw(i)
                    row: dict = dict.fromkeys(out) | {"n_bytes": len(raw)}
                    part = slice(cuts[i], cuts[i + 1])
                    if copies[i]:
                        row |= {"n_removed": len(raw), "n_spans": 1, "kept_sha256": hashlib.sha256(b"").hexdigest()}
                    elif cuts[i] < cuts[i + 1]:
                        marks = np.diff(found.first[here[part]], prepend=piece.offsets[i])
                        row |= {"text": texts[i], "marks": _zipped(marks.astype(np.int32)), "shape": _zipped(some.shape[part])}
                    else:
                        row |= {"n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(raw).hexdigest()}
                    for n in out:
                        out[n].append(row[n])
                own = {n: batch.column(c).slice(at, piece.rows) for n, c in (("_id", 0), ("_key", 1))}
                documents = joined(own | {n: pa.array(out[n], t) for n, t in _KEPT})
                if len(here):
                    yield from asked(block.add(piece, found, here, some, documents, cuts))
                else:
                    yield documents
        yield from asked(block.flush())
        yield from asked(block.packed())

    return run


def _texts(batch: pa.RecordBatch, blob: int, size: int, rows: int = 64) -> Iterator[tuple[int, Slice]]:
    """The texts of compressed rows, some at a time."""
    sizes = batch.column(size).to_pylist()
    at = 0
    while at < batch.num_rows:
        end, total = at, 0
        while end < batch.num_rows and end - at < rows and (end == at or total < STEP):
            total += sizes[end]
            end += 1
        raw = [_CODEC.decompress(x, sizes[k], asbytes=True) for k, x in enumerate(batch.column(blob).slice(at, end - at).to_pylist(), at)]
        offsets = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in raw], out=offsets[1:])
        yield at, Slice(at, np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        at = end


def _entries(piece: Slice, found: Anchors, here: np.ndarray, ids: np.ndarray) -> Entries:
    """The entries of the anchors `here`."""
    at, first, last = found.at[here], found.first[here], found.last[here]
    shape = np.zeros(len(here), dtype=_SHAPE)
    shape["left"], shape["width"] = at - first, last - first + 1
    grid = np.zeros((len(here), _WIDE), dtype=np.uint8)
    padded = np.concatenate([np.zeros(BEFORE, dtype=np.uint8), piece.data, np.zeros(LENGTH, dtype=np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[at] if len(here) else np.zeros((0, COLUMNS), dtype=np.uint8)
    grid[:, :BEFORE] = around[:, :BEFORE][:, ::-1]
    grid[:, BEFORE:COLUMNS] = around[:, BEFORE:]
    _trim(grid, shape["left"], last + LENGTH - at)
    return Entries(ids[found.row[here]], _items(grid, shape), shape, grid)


class Block:
    """A block of documents: equal entries, neighbours in the suffix array of their phrases, go out once."""

    def __init__(self, parts: int, hot: np.ndarray) -> None:
        self.packers, self.hot = (EntryPacker(parts, False), EntryPacker(parts, True)), hot
        self.names: list[np.ndarray] = []
        self.held: list[tuple] = []
        self.size = 0

    def packed(self) -> Iterator[pa.RecordBatch]:
        for packer in self.packers:
            yield from packer.flush()

    def add(self, piece: Slice, found: Anchors, here: np.ndarray, some: Entries, documents: pa.RecordBatch, cuts_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        # An entry's phrases: from the last cut at or before its bytes to the first one at or after them.
        cuts = np.unique(np.concatenate([found.at, piece.offsets]))
        first = np.searchsorted(cuts, found.first[here], side="right") - 1
        last = np.searchsorted(cuts, found.last[here] + LENGTH, side="left")
        edges = np.bincount(first, minlength=len(cuts) + 1) - np.bincount(last, minlength=len(cuts) + 1)
        used = np.flatnonzero(np.cumsum(edges) > 0)
        # Needed phrases in order, and a separator after each stretch of them.
        gap = np.concatenate([np.diff(used) > 1, [True]])
        shift = np.cumsum(gap) - gap
        symbols = np.zeros(len(used) + int(gap.sum()), dtype=U64)
        symbols[np.arange(len(used)) + shift] = hash_spans(piece.data, cuts[used], cuts[used + 1])
        where = np.zeros(len(cuts) + 1, dtype=np.int64)
        where[used] = np.arange(len(used)) + shift + self.size
        self.names.append(symbols)
        self.held.append((some, where[first], found.first[here] - cuts[first], documents, cuts_of))
        self.size += len(symbols)
        if self.size >= BLOCK_PHRASES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The block's documents with what it knows of their windows, and full packs of entries."""
        if not self.held:
            return
        _, code = np.unique(np.concatenate(self.names), return_inverse=True)
        order = suffix_array(code.ravel() + 1)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        every = Entries.joined([x[0] for x in self.held])
        first, shift = (np.concatenate([x[c] for x in self.held]) for c in (1, 2))
        documents = [x[3:] for x in self.held]
        self.names, self.held, self.size = [], [], 0
        # Suffixes that begin with equal phrases are neighbours, so equal entries are a run; their bytes confirm it.
        by = np.lexsort((rank[first], shift, every.shape["width"], every.shape["left"]))
        some = every.take(by)
        same = (some.shape[1:] == some.shape[:-1]) & (some.grid[1:] == some.grid[:-1]).all(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        n = np.diff(np.append(starts, len(some)))
        least = np.minimum.reduceat(some.ids, starts)
        masks = np.zeros(len(some), dtype=np.uint32)
        late = some.ids != np.repeat(least, n)
        masks[by[late]] = _all_bits(some.shape[late])
        class_of = np.repeat(np.arange(len(starts)), n)
        some = some.take(starts)
        some.ids = least
        at = np.arange(len(some)) * _WIDE + BEFORE
        often = _among(hash_spans(some.grid.ravel(), at, at + K) | U64(1), self.hot)
        rare = some.take(~often)
        yield from self.packers[0].add(rare, rare.hashes(BEFORE, BEFORE + K))
        if often.any():
            windows = some.take(often).windows()
            known = earlier_windows(windows) > 0
            bits = np.zeros(len(some), dtype=np.uint32)
            of = np.repeat(np.flatnonzero(often), some.shape["width"][often].astype(np.int64))
            np.bitwise_or.at(bits, of[known], np.uint32(1) << windows.shape["bit"][known].astype(np.uint32))
            masks[by] |= bits[class_of]
            windows = windows.take(~known)
            yield from self.packers[1].add(windows, windows.hashes(0, COLUMNS))
        lo = 0
        for rows, cuts in documents:
            known = [_zipped(masks[lo + a : lo + b]) if a < b else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            lo += int(cuts[-1])
            yield rows.set_column(rows.schema.get_field_index("known"), "known", pa.array(known, pa.binary()))


class Marks:
    """Entries of some texts, as saved: their row, and what `Anchors` has of them."""

    def __init__(self, piece: Slice, marks: list[bytes], shapes: list[bytes]) -> None:
        firsts = [np.cumsum(_unzipped(x, np.int32), dtype=np.int64) for x in marks]
        self.row = np.repeat(np.arange(piece.rows), [len(x) for x in firsts])
        self.first = np.concatenate(firsts) + piece.offsets[self.row]
        shape = np.concatenate([_unzipped(x, _SHAPE) for x in shapes])
        self.at = self.first + shape["left"]
        self.last = self.first + shape["width"] - 1


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, size, marks, shape, known, items, masks) the results of documents with entries."""
    for batch in batches:
        for at, piece in _texts(batch, 1, 2):
            marks, shapes, known, items, masks = (batch.column(c).slice(at, piece.rows).to_pylist() for c in (3, 4, 5, 6, 7))
            held = Marks(piece, marks, shapes)
            near = _entries(piece, held, np.arange(len(held.at)), np.zeros(piece.rows, dtype=np.int64)).items
            mask = np.concatenate([_unzipped(x, np.uint32) for x in known])
            bounds = np.searchsorted(held.row, np.arange(piece.rows + 1))
            for i, answer in enumerate(items):
                if answer:
                    part, told = slice(bounds[i], bounds[i + 1]), np.frombuffer(answer, dtype=U64)
                    place = np.minimum(np.searchsorted(told, near[part]), len(told) - 1)
                    mask[part] |= np.where(told[place] == near[part], np.frombuffer(masks[i], dtype=np.uint32)[place], np.uint32(0))
            gone = np.zeros(len(piece.data) + 1, dtype=bool)
            for bit in range(WINDOW):
                gone[held.first[(mask >> np.uint32(bit)) & np.uint32(1) > 0] + bit] = True
            begin = np.flatnonzero(gone)
            marks = np.bincount(begin, minlength=len(piece.data) + 1) - np.bincount(begin + LENGTH, minlength=len(piece.data) + 1)
            removed = np.cumsum(marks)[:-1] > 0
            spans = np.bincount(piece.row_of(piece.runs(removed)[0]), minlength=piece.rows)
            total = np.concatenate([[0], np.cumsum(removed)])
            digests = [hashlib.sha256(piece.data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, piece.rows),
                    pa.array(np.diff(piece.offsets)),
                    pa.array(total[piece.offsets[1:]] - total[piece.offsets[:-1]]),
                    pa.array(spans),
                    pa.array(digests),
                ],
                names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _parts(size: int) -> int:
    """Parts of an exchange over so many bytes of text."""
    small, large = PART_BYTES
    return max(1, min(size // small, MANY), size // large)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of `docs`.

    Each byte goes that is covered by a 50-byte string (UTF-8) that also
    starts in a document with a smaller id.  Strings are judged on the input.

    A null text is empty.  A null id is greater than all others.  Documents
    with one id, and repeated rows, remove nothing from each other (ties).
    Very long texts are taken whole.  Ids are of any type that has an order.
    Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = order_keys(docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col), F.lit("")).alias("_text")), "_id")
    size, n_docs = rows.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    size, bundles = size or 0, max(1, n_docs // BUNDLE)
    parts = _parts(size)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_anchors(rows))

    anchors = _exchange(rows.select("_key", "_text").mapInArrow(_ask_anchors(parts), _PACKED_DDL), _tell_anchors(bundles), bundles).select("id", F.col("items").alias("shared"))
    digest = F.unhex(F.sha2("_text", 256))
    digests = rows.where(F.octet_length("_text") >= LENGTH).select("_key", digest.alias("_digest"))
    first = digests.groupBy("_digest").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last")
    copies = digests.join(first, "_digest").where("_key > _first").select(F.col("_key").alias("id"), F.col("_digest").alias("copy")).distinct()
    # One row for each id, so that the join below stays on the id alone.
    copies = copies.groupBy("id").agg(F.collect_list("copy").alias("copies"))
    squeezed = rows.select("_id", "_key", digest.alias("_digest"), "_text").mapInArrow(_squeeze, f"_id {kind}, _key long, _digest binary, n_bytes long, text binary")
    met = squeezed.join(anchors, F.col("_key") == anchors["id"], "left").drop("id").join(copies, F.col("_key") == copies["id"], "left").drop("id")
    is_copy = F.coalesce(F.array_contains("copies", F.col("_digest")), F.lit(False))
    schema = pa.schema([("_id", arrow_type(docs, id_col)), ("_key", pa.int64()), *_KEPT, *_PACKED])
    marked = saved(
        met.select("_id", "_key", is_copy.alias("_copy"), "shared", "n_bytes", "text").mapInArrow(_mark(parts, parts, hot, schema), f"_id {kind}, _key long, {_KEPT_DDL}, {_PACKED_DDL}")
    )
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    settled = marked.where("kept_sha256 is not null").select("_id", *results)
    going = marked.where("text is not null").select("_id", "_key", "text", "n_bytes", "marks", "shape", "known")
    known = _exchange(marked.where("part is not null").select(*_PACKED.names), _tell_windows(bundles), bundles)
    whole = going.join(known, F.col("_key") == F.col("id"), "left").select("_id", "text", "n_bytes", "marks", "shape", "known", "items", "masks")
    done = whole.mapInArrow(_finish, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return settled.unionByName(done).withColumnRenamed("_id", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
