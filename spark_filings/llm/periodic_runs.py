"""Periodic runs of words: harmonic grids driven by longest common extensions over a difference cover.

A run of period q is a longest stretch in which words q apart are identical.
For each q the places of a grid, q apart (8 for less), are compared with the
places q later; a run that counts has two neighbouring places of the grid in
it.  From those both ends of the run follow by longest common extensions,
forwards and backwards.

An extension of two places compares few words, less than 13, until both places
are in a difference cover modulo 13 at the same time; from there it is the
least of the common lengths of neighbours between them in the order of the
sampled suffixes, by a sparse table.  Only the sampled suffixes are sorted: by
their first 13 words, and then by doubling, as 13 words on is a sample again.

The documents of a slice are one array, in which a number of its own ends each
of them, so that no extension leaves its document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Slice, arrow_type, column, distinct_spans, slices, table

#: A run has so many words, and so many periods, at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3

#: A perfect difference set: each remainder is the difference of two of its members.
MODULUS = 13
COVER = (0, 1, 3, 9)

#: Places of grids that are compared at once.
AT_ONCE = 1 << 20

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: How far two places have to move on, by their remainders, until both are in the cover.
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


class Extensions:
    """Longest common extensions of places of an array of numbers from 0."""

    def __init__(self, x: np.ndarray) -> None:
        v = MODULUS
        self.x = x = np.concatenate([x, (int(x.max()) + 1 if len(x) else 0) + np.arange(2 * v)]).astype(np.int64)
        last = len(x) - v
        self.places = places = np.flatnonzero(_IN_COVER[np.arange(last + 1) % v])
        self.index = np.full(len(x) + 1, -1, dtype=np.int64)
        self.index[places] = np.arange(len(places))
        bits = max(1, int(x.max()).bit_length())
        each = max(1, 63 // bits)
        keys = []
        for k in range(0, v, each):
            key = np.zeros(len(places), dtype=np.int64)
            for t in range(k, min(v, k + each)):
                key = (key << bits) | x[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(len(places), dtype=np.int64)
        for key in keys:
            differs[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(places), dtype=np.int64)
        rank[order] = np.cumsum(differs)
        levels = [rank]
        while rank.max(initial=0) + 1 < len(places):
            after = places + (v << (len(levels) - 1))
            second = np.where(after <= last, self.index[np.minimum(after, last)], -1)
            second = np.where(second >= 0, rank[second], -1)
            rank = np.unique(rank * (len(places) + 1) + second + 1, return_inverse=True)[1]
            levels.append(rank)
        self.rank = rank
        self.table = self._table(levels)

    def _table(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Common lengths of neighbours in the order of suffixes, and the least of each 2, 4, ... of them."""
        sorted_ = np.empty(len(self.places), dtype=np.int64)
        sorted_[self.rank] = self.places
        a, b = sorted_[:-1], sorted_[1:]
        common = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(levels))):
            i, j = (self.index[np.minimum(p + common, len(self.x))] for p in (a, b))
            common += np.where((i >= 0) & (j >= 0) & (levels[k][i] == levels[k][j]), MODULUS << k, 0)
        table = [(common + self._few(a + common, b + common, np.full(len(a), MODULUS))).astype(np.int32)]
        while len(table[-1]) > 1 << (len(table) - 1):
            width = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        return table

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on, `most` at most."""
        out = most.copy()
        on = np.flatnonzero(most > 0)
        end = len(self.x) - 1
        for t in range(MODULUS):
            if not len(on):
                break
            p, q = i[on] + t, j[on] + t
            same = (self.x[np.minimum(p, end)] == self.x[np.minimum(q, end)]) & (np.maximum(p, q) <= end)
            out[on[~same]] = t
            on = on[same]
            on = on[most[on] > t + 1]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common lengths of the suffixes from places i and j on (i < j)."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = self._few(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = self.rank[self.index[i[on] + shift[on]]], self.rank[self.index[j[on] + shift[on]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.log2(hi - lo).astype(np.int64)
        least = np.empty(len(on), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            least[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k)])
        out[on] += least
        return out


class Joined:
    """Documents of some words each as one array, longest first; `doc` says whose a place is."""

    def __init__(self, words: list[np.ndarray], least: int, periods: int) -> None:
        self.least, self.periods = least, periods
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        top = max((int(w.max(initial=0)) for w in words), default=0) + 1
        parts = []
        for k, d in enumerate(self.order.tolist()):
            parts += [words[d], np.array([top + k])]
        self.x = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        sizes = self.size[self.order]
        self.doc = np.repeat(self.order, sizes + 1)
        self.start = np.zeros(len(words), dtype=np.int64)
        self.start[self.order] = np.cumsum(sizes + 1) - sizes - 1
        self.periods_of = np.arange(1, int(sizes.max(initial=0)) // periods + 1)
        enough = np.searchsorted(-sizes, -np.maximum(least, periods * self.periods_of), side="right")
        self.step = np.maximum(self.periods_of, least // 3)
        self.points = np.concatenate([[0], np.cumsum(sizes + 1)])[enough] // self.step

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, period) where this place of the period's grid and the next one equal the places a period later."""
        ends = np.cumsum(self.points)
        first = 0
        while first < len(self.points):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
            points = self.points[first:last]
            begin = np.cumsum(points) - points
            number = np.arange(int(points.sum())) - np.repeat(begin, points)
            place = number * np.repeat(self.step[first:last], points)
            later = place + np.repeat(self.periods_of[first:last], points)
            same = self.x[place] == self.x[np.minimum(later, len(self.x) - 1)]
            both = np.flatnonzero(same[:-1] & same[1:] & (number[1:] > 0))
            place, later = place[both], later[both]
            inside = (later < len(self.x)) & (self.doc[place] == self.doc[np.minimum(later, len(self.x) - 1)])
            yield place[inside], (later - place)[inside]
            first = last


def runs_of(words: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents given as numbers of words: (document, start, length, period), ordered by the first two and the period."""
    all_ = Joined(words, least, periods)
    some = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(all_.doc[place] for place, _ in all_.hits())]))
    found = [np.zeros((4, 0), dtype=np.int64)]
    if len(some):
        joined = Joined([words[d] for d in some.tolist()], least, periods)
        forwards, backwards = Extensions(joined.x), Extensions(joined.x[::-1])
        n = len(joined.x)
        for place, period in joined.hits():
            after = forwards.common(place, place + period)
            before = np.zeros(len(place), dtype=np.int64)
            inner = np.flatnonzero(place > 0)
            before[inner] = backwards.common(n - place[inner] - period[inner], n - place[inner])
            length = before + after + period
            doc = joined.doc[place]
            start = place - before - joined.start[doc]
            on = length >= np.maximum(least, periods * period)
            found.append(_smallest(np.stack([some[doc[on]], start[on], length[on], period[on]])))
    return tuple(_smallest(np.concatenate(found, axis=1))[:, :])


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period.

    A stretch of three periods whose smallest period is less has it as a
    divisor, so that it is a run of that period with the same ends.
    """
    doc, start, length, period = rows
    rows = rows[:, np.lexsort((period, length, start, doc))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    rows = rows[:, new]
    return rows[:, np.lexsort((rows[3], rows[1], rows[0]))]


def greatest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of the greatest exact length / period; of equals the first by start, then period."""
    best = 0
    for k in range(1, len(start)):
        more = length[k] * period[best] - length[best] * period[k]
        if more > 0 or (more == 0 and (start[k], period[k]) < (start[best], period[best])):
            best = k
    return best


def _texts(part: Slice, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> pa.Array:
    """For each row its words, given by row, joined by one space."""
    size = ends - starts
    space = np.ones(len(size), dtype=np.int64)
    space[-1:] = 0
    space[:-1] = rows[1:] == rows[:-1]
    total = size + space
    at = np.cumsum(total) - total
    data = np.full(int(total.sum()), 0x20, dtype=np.uint8)
    shift = np.repeat(starts - (np.cumsum(size) - size), size)
    inside = np.arange(len(shift))
    data[inside + np.repeat(at - (np.cumsum(size) - size), size)] = part.data[inside + shift]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=total, minlength=part.rows))]).astype(np.int32)
    return pa.StringArray.from_buffers(part.rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "struct<start: long, length: long, period: long>"


def _of_slice(part: Slice, least: int, periods: int) -> list[pa.Array]:
    starts, ends, rows = part.words()
    same, _ = distinct_spans(part.data, starts, ends)
    per_row = np.bincount(rows, minlength=part.rows)
    first = np.cumsum(per_row) - per_row
    able = np.flatnonzero(per_row >= least)
    doc, start, length, period = runs_of([same[first[r] : first[r] + per_row[r]] for r in able.tolist()], least, periods)
    doc = able[doc] if len(doc) else doc
    edges = np.zeros(len(same) + 1, dtype=np.int64)
    np.add.at(edges, first[doc] + start + period, 1)
    np.add.at(edges, first[doc] + start + length, -1)
    kept = np.cumsum(edges)[: len(same)] == 0
    n_runs = np.bincount(doc, minlength=part.rows)
    held = np.concatenate([[0], np.cumsum(n_runs)])
    runs = pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
    columns = [x.tolist() for x in (start, length, period)]
    best: list[dict | None] = [None] * part.rows
    for r in np.flatnonzero(n_runs).tolist():
        own = [c[held[r] : held[r + 1]] for c in columns]
        k = greatest(*own)
        best[r] = {"start": own[0][k], "length": own[1][k], "period": own[2][k]}
    return [runs, pa.array(best, _RUN), _texts(part, starts[kept], ends[kept], rows[kept])]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Return (id_col, runs, greatest, collapsed), a row for each row of `docs`, in one narrow pass.

    `runs` are all runs of the text's words as (start, length, period), by
    start, then period: stretches with smallest period q and at least
    `least_words` words and `least_periods` (2 or more periods, 3 or more words
    a grid needs) times q that no neighbouring word extends.  `greatest` is
    the one of the greatest length / period (ties: first start, then smallest
    period), null without runs.  `collapsed` is the text without words that a
    run has after its first period, joined by one space.

    A null or empty text, and one without words, has no runs and the empty
    text left.  Null, repeated and tied ids keep their rows.  A text of any
    length is searched whole, in memory that grows with it.  Other columns are
    ignored; an empty table gives an empty result.
    """
    if least_periods < LEAST_PERIODS or least_words < LEAST_WORDS:
        raise ValueError(f"runs have {LEAST_PERIODS} periods and {LEAST_WORDS} words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("runs", pa.list_(_RUN)), ("greatest", _RUN), ("collapsed", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                out = _of_slice(part, least_words, least_periods)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), *out], schema=schema)

    rows = docs.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    name = id_col.replace("`", "``")
    return rows.mapInArrow(run, f"`{name}` {kind}, runs array<{_RUN_DDL}>, greatest {_RUN_DDL}, collapsed string")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text; of each tenth id by crc32, its words from some place on repeat those of a period there.

    A null id has no such number and its text stays.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        head = F.slice(words, F.lit(1), a.cast("int"))
        tail = F.transform(F.sequence(F.lit(0), (n - a - 1).cast("int")), lambda k: F.get(words, (a + k % p).cast("int")))
        return F.array_join(F.concat(head, tail), " ")

    # The words are an argument of the function, so that they are found once and not for each of them.
    words = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})")))
    planted = F.element_at(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("greatest.start").alias("start"),
        F.col("greatest.length").alias("length"),
        F.col("greatest.period").alias("period"),
        F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
