"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two order-1 Markov models over characters are trained by counting bigrams in
labelled samples from all documents: the values that the fixed patterns find
are random strings, all other tokens are ordinary.  The stretch of a long token
whose log-likelihood ratio is largest is a span of its own kind if the ratio
exceeds the prior odds against a secret, and so on in what is left of the
token; spans of the fixed patterns always stay.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_LEAD, Slice, column, slices, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Tokens that the models judge: runs of these characters.
TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(TOKEN)

#: A stretch has one step between characters at least; beyond that the evidence alone decides.
LEAST_TOKEN = 2

#: A span of the models reaches to the next of these.
SEPARATORS = b"=/-_"

#: Natural logarithm of the odds that a long token is ordinary.
PRIOR = math.log(1e6)
SMOOTHING = 0.5

#: Share of independent uniform characters in the random and in the ordinary model.
UNIFORM = (0.5, 0.05)

_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(TOKEN, dtype=np.uint8)] = np.arange(N)
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[np.frombuffer(SEPARATORS, dtype=np.uint8)] = True
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = True

Span = tuple[int, int, str, int, int]


def base_spans(piece: Slice) -> list[Span]:
    """(row, start, kind, end, start of the value) of the fixed patterns, offsets in bytes of the slice."""
    found: list[Span] = []
    starts, ends = piece.runs(_IS_HEX[piece.data])
    long = ends - starts >= LEAST["hex"]
    for s, e, row in zip(starts[long].tolist(), ends[long].tolist(), piece.row_of(starts[long]).tolist()):
        found.append((row, s, "hex", e, s))
    whole = piece.data.tobytes()
    akia = b"AKIA" in whole
    joins = np.flatnonzero((piece.data == 58) | (piece.data == 61))
    for row in range(piece.rows) if akia else np.unique(piece.row_of(joins)).tolist():
        lo, hi = int(piece.offsets[row]), int(piece.offsets[row + 1])
        raw = whole[lo:hi]
        low = raw.lower()
        # Decoding byte by byte keeps offsets, and no pattern matches a byte beyond ASCII.
        if any(h in low for h in HINTS):
            text = raw.decode("latin-1")
            found += [(row, lo + m.start(), "assign", lo + m.end(), lo + m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
        if akia and b"AKIA" in raw:
            text = raw.decode("latin-1")
            found += [(row, lo + m.start(), "access", lo + m.end(), lo + m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found


def _bigrams(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring token characters, N x N flat."""
    code = _CODE[data]
    pair = (code[:-1] >= 0) & (code[1:] >= 0)
    return np.bincount(code[:-1][pair] * N + code[1:][pair], minlength=N * N)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random, ordinary = np.zeros(N * N, dtype=np.int64), np.zeros(N * N, dtype=np.int64)
    for batch in batches:
        for piece in slices(batch.column(0)):
            plain = piece.data.copy()
            plain[piece.offsets[:-1][piece.offsets[:-1] < len(plain)]] = 32  # no bigram across rows
            for _, start, _, end, value in base_spans(piece):
                random += _bigrams(piece.data[value:end])
                plain[start:end] = 32
            ordinary += _bigrams(plain)
    for label, counts in ((1, random), (0, ordinary)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["label", "cell", "n"])


def train_markov(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios of character bigrams, random over ordinary, from all documents.

    The counts are N x N for either label, whatever the size of the corpus.
    Either model is a mixture of what the labelled samples give and of
    independent uniform characters, so that few samples do not overfit and one
    unusual pair in an identifier counts for little.  Without any text the ratios are those of the smoothing alone (all 0).
    """
    cells = docs.select(column(text_col)).mapInArrow(_count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n")).collect()
    counts = np.zeros((2, N * N))
    for label, cell, n in cells:
        counts[label, cell] = n
    counts = counts.reshape(2, N, N)
    model = (counts + SMOOTHING) / (counts.sum(axis=2, keepdims=True) + SMOOTHING * N)
    mixed = [(1 - u) * m + u / N for u, m in zip(UNIFORM, (model[1], model[0]))]
    return np.log(mixed[0]) - np.log(mixed[1]) if counts.any() else np.zeros((N, N))


class _Best:
    """The best stretch within any part of a run, by a tree of parts.

    [a, b) scores total[b] - total[a + 1] (the step into a stretch does not
    count) and has LEAST_TOKEN characters or more.  Each node has the least
    total before and the greatest after of its places, and its best pair; so a
    part is asked in as many nodes as the run's length has digits.
    """

    def __init__(self, total: np.ndarray) -> None:
        n = len(total) - LEAST_TOKEN
        low, high = total[1 : n + 1], total[LEAST_TOKEN:]
        at = np.arange(n)
        self.levels = [(low, at, high, at, high - low, at, at)]
        while n > 1:
            if n % 2:
                pad = (np.inf, 0, -np.inf, 0, -np.inf, 0, 0)
                self.levels[-1] = tuple(np.append(x, x.dtype.type(p)) for x, p in zip(self.levels[-1], pad))
            left, right = [tuple(x[k::2] for x in self.levels[-1]) for k in (0, 1)]
            self.levels.append(self._merged(left, right, np.where))
            n = len(self.levels[-1][0])
        self.nodes = [list(zip(*(x.tolist() for x in level))) for level in self.levels]

    @staticmethod
    def _merged(left: tuple, right: tuple, where) -> tuple:
        """Of equal scores the pair that ends first, and of those the one that begins first."""
        keep = left[0] <= right[0]
        low, low_at = where(keep, left[0], right[0]), where(keep, left[1], right[1])
        keep = left[2] >= right[2]
        high, high_at = where(keep, left[2], right[2]), where(keep, left[3], right[3])
        across = right[2] - left[0]
        own = (right[4] > across) | ((right[4] == across) & (right[6] < right[3]))
        best, i, j = where(own, right[4], across), where(own, right[5], left[1]), where(own, right[6], right[3])
        keep = left[4] >= best
        return low, low_at, high, high_at, where(keep, left[4], best), where(keep, left[5], i), where(keep, left[6], j)

    def of(self, lo: int, hi: int) -> tuple[float, int, int]:
        """(score, a, b) of the best stretch within [lo, hi)."""
        lo, hi, level, front, back = lo, hi - LEAST_TOKEN + 1, 0, [], []
        while lo < hi:
            if lo & 1:
                front.append(self.nodes[level][lo])
                lo += 1
            if hi & 1:
                hi -= 1
                back.append(self.nodes[level][hi])
            lo, hi, level = lo >> 1, hi >> 1, level + 1
        parts = front + back[::-1]
        out = parts[0]
        for part in parts[1:]:
            out = self._merged(out, part, lambda c, x, y: x if c else y)
        return out[4], out[5], out[6] + LEAST_TOKEN


def _stretches(total: np.ndarray, separates: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one run that are rather random, from prefix sums `total` of its steps.

    The best stretch of LEAST_TOKEN characters or more is widened to the next
    separators, and loses parts at its edges that are rather ordinary; what is
    left on either side is judged on its own.  Two such values that what is
    between them does not outweigh are one stretch.  A stretch costs as many
    steps as the run's length has digits, so a run costs little more than its
    length.
    """
    if len(separates) < LEAST_TOKEN:
        return []
    best = _Best(total)
    at = np.flatnonzero(separates).tolist()
    found, left = [], [(0, len(separates))]
    while left:
        lo, hi = left.pop()
        if hi - lo < LEAST_TOKEN:
            continue
        gain, a, b = best.of(lo, hi)
        if gain <= PRIOR:
            continue
        k, m = bisect_left(at, a), bisect_left(at, b)
        start = at[k - 1] + 1 if k and at[k - 1] >= lo else lo
        end = at[m] if m < len(at) and at[m] < hi else hi
        # A name or folder at an edge, of which the stretch took the last characters, is ordinary as a whole.
        for k in range(bisect_left(at, start), m):
            cut = at[k]
            if end - cut <= LEAST_TOKEN or total[cut] - total[min(start + 1, cut)] > 0:
                break
            start = cut + 1
        for k in range(bisect_left(at, end) - 1, bisect_left(at, start) - 1, -1):
            cut = at[k]
            if cut - start < LEAST_TOKEN or total[end] - total[min(cut + 2, end)] > 0:
                break
            end = cut
        found.append((start, end))
        left += [(lo, start), (end, hi)]
    return found


def markov_spans(piece: Slice, ratios: np.ndarray, taken: list[Span]) -> list[Span]:
    """Stretches of long tokens, as far as they are outside the spans `taken`, that are rather random than ordinary."""
    code = _CODE[piece.data]
    free = code >= 0
    for _, s, _, e, _ in taken:
        free[s:e] = False
    starts, ends = piece.runs(free)
    long = ends - starts >= LEAST_TOKEN
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    step = np.zeros(len(code))
    both = (code[:-1] >= 0) & (code[1:] >= 0)
    step[1:][both] = ratios[code[:-1][both], code[1:][both]]
    total, most = (np.concatenate([[0.0], np.cumsum(x)]) for x in (step, np.maximum(step, 0)))
    # No stretch has more than all positive steps of its run.
    may = most[ends] - most[starts + 1] > PRIOR
    starts, ends = starts[may], ends[may]
    separates = _SEPARATES[piece.data]
    return [
        (row, s + a, "markov", s + b, s + a)
        for s, e, row in zip(starts.tolist(), ends.tolist(), piece.row_of(starts).tolist())
        for a, b in _stretches(total[s : e + 1], separates[s:e])
    ]


def _scan(ratios: np.ndarray):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                spans: list[list] = [[] for _ in range(piece.rows)]
                base = base_spans(piece)
                points = np.concatenate([[0], np.cumsum(IS_LEAD[piece.data])])  # code points before each byte
                for row, s, k, e, _ in sorted(base + markov_spans(piece, ratios, base), key=lambda x: (x[0], x[1], KINDS.index(x[2]))):
                    before = int(points[s] - points[piece.offsets[row]])
                    spans[row].append({"kind": k, "start": before, "end": before + e - s})  # spans are ASCII
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(spans, kind)], names=["_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, ratios: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, spans), a row for each row of `docs`.

    `spans` is an array of (kind, start, end) in code points, end exclusive, by
    start and then by kind.  `ratios` comes from `train_markov`; by default it
    is trained on `docs`.

    A null text is empty and has no spans.  A null id keeps its row.  Repeated
    rows are scanned alike.  Spans that start at one place (ties) come in the
    order of KINDS.  Very long texts are scanned whole, in time that grows with
    their length.  Other columns are ignored; an empty table gives an empty
    result.
    """
    if ratios is None:
        ratios = train_markov(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    return rows.mapInArrow(_scan(ratios), f"_id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("_id", id_col)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(n, KINDS[:3]),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        n("markov"),
    )


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
