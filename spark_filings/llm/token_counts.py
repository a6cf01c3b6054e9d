"""Token counts of a merge (BPE) model: rank-synchronous array merging.

A text's symbols are its code points.  Of all neighbouring symbols whose joint
string is a piece, the pair of the lowest rank (the leftmost of equals) is
merged, until none is left.  Two neighbouring code points that stand together
in no piece are never merged, so a text falls into pre-tokens there, exactly.

The distinct pre-tokens of a batch of texts are held as arrays by their number
of symbols.  In each round every sequence that still has a pair merges its
own lowest-ranked one, all sequences at once; they then have one symbol less,
so an array stays rectangular, and sequences without a pair leave with their
number of surviving symbols.  A pre-token of more than LONG code points, which
would take as many rounds, takes its pairs in the same order from a queue.

Surviving code points that are no piece count their UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_LEAD, U64, Slice, arrow_type, column, distinct_spans, mix64, slices, table

LIMIT = 4096

#: Longest sequence that is merged in rounds.
LONG = 64

#: Bytes of text that share their pre-tokens.
SLICE = 1 << 21

_MARK = "▁"
_NONE = np.iinfo(np.int32).max


def default_model() -> str:
    """The public 32k model of the installed tokenizer files (described in /opt/tokenizers/README.md)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges:
    """Symbols of a model: ids of code points first (0: no piece holds it), then pieces; and what two of them make."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        characters = sorted({c for p in score for c in p})
        ids = {c: k + 1 for k, c in enumerate(characters)}
        for p in score:
            ids.setdefault(p, len(ids) + 1)
        self.code = np.zeros(0x110000, dtype=np.uint16 if len(characters) < 1 << 16 else np.uint32)
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.code[0x20] = self.code[ord(_MARK)]
        if any(c not in score for c in characters):
            raise ValueError("each code point of a piece must be a piece")
        self.mark = int(self.code[ord(_MARK)])
        size = len(characters) + 1
        self.together = np.zeros((size, size), dtype=bool)
        keys, made, ranks = [], [], []
        for p, s in score.items():
            for k in range(1, len(p)):
                self.together[ids[p[k - 1]], ids[p[k]]] = True
                if p[:k] in ids and p[k:] in ids:
                    keys.append(ids[p[:k]] << 32 | ids[p[k:]])
                    made.append(ids[p])
                    ranks.append(order[s])
        self._fill(np.array(keys, dtype=U64), np.array(made, dtype=np.int32), np.array(ranks, dtype=np.int32))

    def _fill(self, keys: np.ndarray, made: np.ndarray, ranks: np.ndarray) -> None:
        """A table with open addressing: what is not at its place is in the next free one."""
        self.mask = (1 << max(4, int(4 * len(keys) + 1).bit_length())) - 1
        self.keys, self.at = np.zeros(self.mask + 1, dtype=U64), np.zeros(self.mask + 1, dtype=np.int32)
        self.probes = 0
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[place] == 0
            slots, first = np.unique(place[free], return_index=True)
            taken = left[free][first]
            self.keys[slots], self.at[slots] = keys[taken], taken
            rest = ~np.isin(left, taken)
            left, place = left[rest], (place[rest] + 1) & self.mask
            self.probes += 1
        self.made, self.ranks = made, ranks

    def _place(self, keys: np.ndarray) -> np.ndarray:
        x = keys * U64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(32)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (_NONE: no piece) and the symbol that it makes."""
        keys = (left.astype(U64) << U64(32)) | right.astype(U64)
        place = self._place(keys)
        rank, made = np.full(keys.shape, _NONE, dtype=np.int32), np.zeros(keys.shape, dtype=np.int32)
        open_ = np.arange(keys.size)
        flat, place = keys.ravel(), place.ravel()
        for _ in range(self.probes):
            held = self.keys[place]
            hit = held == flat[open_]
            at = self.at[place[hit]]
            rank.ravel()[open_[hit]], made.ravel()[open_[hit]] = self.ranks[at], self.made[at]
            on = ~hit & (held != 0)
            open_, place = open_[on], (place[on] + 1) & self.mask
            if not len(open_):
                break
        return rank, made


@functools.lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def surviving(model: Merges, symbols: np.ndarray) -> np.ndarray:
    """Number of symbols left of each row of `symbols`, all of one length."""
    rows, width = symbols.shape
    left = np.full(rows, width, dtype=np.int64)
    who, current = np.arange(rows), symbols.astype(np.int32)
    rank, made = model.pairs(current[:, :-1], current[:, 1:])
    while width > 1:
        best = rank.argmin(axis=1)
        on = rank[np.arange(len(who)), best] != _NONE
        left[who[~on]] = width
        who, best, current, rank, made = who[on], best[on], current[on], rank[on], made[on]
        if not len(who):
            return left
        at = np.arange(len(who))
        current[at, best] = made[at, best]
        # What follows the pair moves one place to the left.
        keep = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
        current = np.take_along_axis(current, keep, axis=1)
        width -= 1
        if width > 1:
            rank, made = (np.take_along_axis(x, np.minimum(keep[:, : width - 1] + (keep[:, : width - 1] == best[:, None]), width - 1), axis=1) for x in (rank, made))
            for place, there in ((best - 1, best > 0), (best, best < width - 1)):
                r, p = at[there], place[there]
                rank[r, p], made[r, p] = model.pairs(current[r, p], current[r, p + 1])
    left[who] = width
    return left


def surviving_long(model: Merges, symbols: np.ndarray) -> int:
    """The same for one long sequence: pairs wait in a queue by rank, then place."""
    n = len(symbols)
    rank, made = model.pairs(symbols[:-1], symbols[1:])
    symbol = symbols.tolist()
    queue = [(r, i, i + 1, symbol[i], symbol[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != _NONE]
    heapq.heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, m = model.pairs(np.array([a]), np.array([b]))
            known[a, b] = int(r[0]), int(m[0])
        return known[a, b]

    left = n
    while queue:
        _, i, j, a, b, m = heapq.heappop(queue)
        if symbol[i] != a or symbol[j] != b or after[i] != j:
            continue
        symbol[i], symbol[j] = m, -1
        left -= 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                r, made_by = pair(symbol[x], symbol[y])
                if r != _NONE:
                    heapq.heappush(queue, (r, x, y, symbol[x], symbol[y], made_by))
    return left


def token_counts(model: Merges, part: Slice) -> np.ndarray:
    """Tokens of each text of a slice."""
    points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    before = np.concatenate([[0], np.cumsum(IS_LEAD[part.data])])[part.offsets]
    filled = np.flatnonzero(np.diff(before))
    total = np.zeros(part.rows, dtype=np.int64)
    if not len(filled):
        return total
    # A text begins with a mark of its own.
    code = np.insert(model.code[points], before[:-1][filled], model.mark)
    first = before[:-1][filled] + np.arange(len(filled))
    cut = np.ones(len(code) + 1, dtype=bool)
    cut[1:-1] = ~model.together[code[:-1], code[1:]]
    cut[first] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    size = ends - starts
    count = np.ones(len(starts), dtype=np.int64)
    long = np.flatnonzero(size > LONG)
    for k in long.tolist():
        count[k] = surviving_long(model, code[starts[k] : ends[k]])
    several = np.flatnonzero((size > 1) & (size <= LONG))
    width = code.dtype.itemsize
    same, one = distinct_spans(code.view(np.uint8), starts[several] * width, ends[several] * width)
    sample = several[one]
    found = np.zeros(len(sample), dtype=np.int64)
    for n in np.unique(size[sample]).tolist():
        rows = np.flatnonzero(size[sample] == n)
        # Arrays of bounded size, however many sequences have this length.
        for lo in range(0, len(rows), 1 << 15):
            some = rows[lo : lo + (1 << 15)]
            found[some] = surviving(model, code[starts[sample[some]][:, None] + np.arange(n)])
    count[several] = found[same]
    summed = np.concatenate([[0], np.cumsum(count)])
    inside = np.searchsorted(starts, [*first.tolist(), len(code)])
    total[filled] = np.diff(summed[inside])
    # Code points that are no piece are written in bytes; no piece holds them, so they survive.
    extra = np.zeros(len(points), dtype=np.int64)
    unknown = np.flatnonzero(model.code[points] == 0)
    extra[unknown] = sum((points[unknown] >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))
    return total + np.diff(np.concatenate([[0], np.cumsum(extra)])[before])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Return (id_col, n_bytes, n_tokens, over_limit): a row for each row of `docs`, in one narrow pass.

    `model` is the path of a merge model with byte fallback and without a
    normalizer, whose pieces are made of code points that are pieces, present on every executor; over_limit says that a text has
    more than `limit` tokens.  No begin, end or special tokens are added, and
    their strings inside a text are ordinary text.

    A null text is empty and has no tokens.  Null, repeated and tied ids keep
    their rows.  Texts of any length are counted whole; their pre-tokens too.
    Other columns are ignored; an empty table gives an empty result.
    """
    path = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merges(path)
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                n = token_counts(known, part)
                ids = batch.column(0).slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(part.offsets)), pa.array(n), pa.array(n > limit)], schema=schema)

    rows = docs.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    name = id_col.replace("`", "``")
    return rows.mapInArrow(run, f"`{name}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}
