"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

Tokens have codes: the most frequent ones one each by rank, the others share
hashed codes.  Codes fall into 256 buckets (the most frequent tokens have
their own), which form 16 classes of buckets of like frequency.  The
probability of a word is that of its class, times that of its bucket in the
class, times that of the word in its bucket.  The first two are softmaxes over
sums of weights of hashed features: the previous word, the previous two
(n-grams) and the one before the previous (skip).  The last is the word's
smoothed share of its bucket's count, so the whole is normalised over the
vocabulary and an unknown word.

Training gathers token counts of all training documents, then trains the
weights in rounds: documents are dealt into shards, each task makes gradient
updates from the common weights over its shard, and the weights are averaged
by token in a tree of bounded width.  Weight tables grow with the number of
tokens (`Tables.of`).  A token's code is kept as two bytes, so rounds and
scoring read those instead of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, column, mix64, saved, slices, table

CLASSES, IN_CLASS = 16, 16
BUCKETS = CLASSES * IN_CLASS

#: The most frequent tokens with a bucket, and with a code, of their own.
OWN_BUCKETS = 192
OWN_CODES = 1 << 15
CODES = 1 << 16

#: Rows of the larger weight table: a power of two, one for each ROW_TOKENS training tokens, within these bounds.
ROW_TOKENS = 1024
LEAST_ROWS, MOST_ROWS = 1 << 17, 1 << 21


@dataclass(frozen=True)
class Tables:
    """Rows of the weights of classes (by feature) and of buckets (by feature and class), both hashed."""

    classes: int
    inner: int

    @classmethod
    def of(cls, tokens: int) -> Tables:
        inner = min(max(1 << math.ceil(math.log2(max(tokens // ROW_TOKENS, 1))), LEAST_ROWS), MOST_ROWS)
        return cls(inner // 4, inner)


#: Every task holds the counts of at most so many of the most frequent tokens; others are joined.
HEAD = 200_000

#: Steps into which counts are sorted to find those, in powers of two.
STEPS = 16

#: Distinct words that a task holds before it passes its counts on.
FLUSH = 1_000_000

#: A shard has so many tokens for each row of the larger table, so that the weights which shards send stay in proportion to the text.
SHARD_TOKENS = 32
ROUNDS = 2
MINIBATCH = 1 << 11
#: The step of the gradient, and the squares that each weight begins with: they keep what few tokens say small.
RATE = 0.3
SQUARES = 1.0
FAN_IN = 32
#: Pieces in which weights travel.
BLOCKS = 64

END = int(mix64(np.array([1]), 901)[0])
_START = CODES
SMOOTH = 0.1

#: The bucket of each code.
_BUCKET_OF = np.where(np.arange(CODES) < OWN_BUCKETS, np.arange(CODES), OWN_BUCKETS + (mix64(np.arange(CODES), 902) % U64(BUCKETS - OWN_BUCKETS)).astype(np.int64)).astype(np.int32)


def _shared_code(hashes: np.ndarray) -> np.ndarray:
    return OWN_CODES + ((hashes >> U64(48)) % U64(CODES - OWN_CODES)).astype(np.int64)


def is_held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[new], np.add.reduceat(counts, new)

    def out(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(hashes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], names=["h", "c"])

    for batch in batches:
        for piece in slices(batch.column(0)):
            hashes, n = np.unique(piece.word_hashes()[0], return_counts=True)
            parts += [(hashes, n), (np.array([END], dtype=U64), np.array([piece.rows]))]
            size += len(hashes)
        if size > FLUSH:
            parts = [merged()]
            size = len(parts[0][0])
            if size > FLUSH // 2:
                yield from out(*parts.pop())
                size = 0
    if parts:
        yield from out(*merged())


def _look_up(head) -> object:
    """Per document: sums over frequent tokens, the other tokens, and two bytes of each token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, codes = head.value
        for batch in batches:
            for piece in slices(batch.column(2)):
                words, row = piece.word_hashes()
                n = np.bincount(row, minlength=piece.rows)
                # The end follows each document's words.
                last = np.cumsum(n)
                hashes = np.insert(words, last, U64(END))
                row = np.insert(row, last, np.arange(piece.rows))
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
                total = np.bincount(row[known], weights=logs[at[known]], minlength=piece.rows)
                rare, rare_row = hashes[~known], row[~known]
                order = np.lexsort((rare, rare_row))
                rare, rare_row = rare[order], rare_row[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(rare)]]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rare_row[first], minlength=piece.rows))]).astype(np.int32)
                code = _shared_code(hashes)
                code[known] = codes[at[known]]
                code = code.astype(np.uint16)
                cuts = np.concatenate([[0], np.cumsum(n + 1)]) * 2
                own = [batch.column(c).slice(piece.first, piece.rows) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array(n + 1),
                        pa.array(total),
                        pa.array(np.bincount(row[known], minlength=piece.rows)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(rare[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                        pa.Array.from_buffers(pa.binary(), piece.rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(code)]),
                    ],
                    names=["_id", "_held", "n_tokens", "_sum", "_known", "_rare", "_times", "_codes"],
                )

    return run


_SALT = [mix64(np.arange(CODES + 1), 600 + k) for k in range(4)]


class Model:
    """Weights: `classes` (row, class) and `inner` (row, bucket in class), and fixed biases."""

    def __init__(self, bias: np.ndarray, tables: Tables, classes: np.ndarray | None = None, inner: np.ndarray | None = None) -> None:
        self.bias, self.tables = bias, tables
        self.class_bias = np.log(bias.reshape(CLASSES, IN_CLASS).sum(axis=1)).astype(np.float32)
        self.inner_bias = np.log(bias).reshape(CLASSES, IN_CLASS).astype(np.float32)
        self.classes = np.zeros((tables.classes, CLASSES), dtype=np.float32) if classes is None else classes
        self.inner = np.zeros((tables.inner, IN_CLASS), dtype=np.float32) if inner is None else inner

    def flat(self) -> np.ndarray:
        return np.concatenate([self.classes.ravel(), self.inner.ravel()])

    def with_flat(self, flat: np.ndarray) -> Model:
        n = self.tables.classes * CLASSES
        return Model(self.bias, self.tables, flat[:n].reshape(-1, CLASSES), flat[n:].reshape(-1, IN_CLASS))

    def copy(self) -> Model:
        return Model(self.bias, self.tables, self.classes.copy(), self.inner.copy())

    def inner_row(self, row: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The row of `inner` for a feature's row and a class."""
        return ((row * 0x9E3779B1 + np.int64(kind) * 0x85EBCA77) >> 7) & (self.tables.inner - 1)

    def features(self, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Weight rows of each token's context; documents begin at `starts`."""
        before, before2 = np.full(len(codes), _START, dtype=np.int64), np.full(len(codes), _START, dtype=np.int64)
        before[1:], before2[2:] = codes[:-1], codes[:-2]
        before[starts] = _START
        before2[starts] = _START
        second = starts + 1
        before2[second[second < len(codes)]] = _START
        mask = U64(self.tables.classes - 1)
        hashed = _SALT[0][before], (_SALT[1][before] ^ (_SALT[2][before2] * U64(31))) >> U64(20), _SALT[3][before2]
        return [(h & mask).astype(np.int64) for h in hashed]

    def forward(self, rows: list[np.ndarray], bucket: np.ndarray, within: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of classes and of buckets in the true class, and log probabilities; `within`: rows of `inner`, if known."""
        kind, inside = bucket >> 4, bucket & 15
        within = within or [self.inner_row(r, kind) for r in rows]
        a, b = self.classes.take(rows[0], axis=0), self.inner.take(within[0], axis=0)
        a += self.class_bias
        b += self.inner_bias.take(kind, axis=0)
        for r, w in zip(rows[1:], within[1:]):
            a += self.classes.take(r, axis=0)
            b += self.inner.take(w, axis=0)
        first = np.arange(len(bucket)) * IN_CLASS
        logs = a.take(first + kind) + b.take(first + inside)
        out = []
        for x in (a, b):
            # A column for each token: sums and maxima then run over whole rows at once.
            x = x.T.copy()
            top = x.max(axis=0)
            x -= top
            np.exp(x, out=x)
            total = x.sum(axis=0)
            x /= total
            logs -= top
            logs -= np.log(total)
            out.append(x.T.copy())
        return *out, logs


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of some documents in a row, and where each begins."""
    raw = [x.as_buffer() for x in column]
    sizes = np.array([len(x) // 2 for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint16), np.cumsum(sizes) - sizes


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row moved as one item."""
    item = f"V{table.itemsize * table.shape[1]}"
    table.view(item)[:, 0].put(at, rows.view(item)[:, 0])


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """An adaptive gradient step on the rows of a weight table."""
    # Rows and places in one number sort fast and keep ties in order.
    packed = np.sort((rows << 14) | np.arange(len(rows)))
    rows, order = packed >> 14, packed & (MINIBATCH - 1)
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    at, times = rows[new], np.diff(new, append=len(rows))
    total = gradient.take(order[new], axis=0)
    # Sums are slow by row, and most rows occur once.
    many = np.flatnonzero(times > 1)
    if len(many):
        n = times[many]
        total[many] = np.add.reduceat(gradient.take(order[np.repeat(times > 1, times)], axis=0), np.cumsum(n) - n, axis=0)
    held = squares.take(at, axis=0)
    held += total * total
    _put(squares, at, held)
    np.sqrt(held, out=held)
    total *= RATE
    total /= held
    _put(weights, at, weights.take(at, axis=0) - total)


def _train(model) -> object:
    def run(group: pa.Table) -> pa.Table:
        own = model.value.copy()
        squares = [np.full_like(own.classes, SQUARES), np.full_like(own.inner, SQUARES)]
        seen = 0
        for column in group.column("_codes").chunks:
            for lo in range(0, len(column), 256):
                codes, starts = _tokens(column.slice(lo, 256))
                rows = own.features(codes, starts)
                bucket = _BUCKET_OF[codes]
                for k in range(0, len(codes), MINIBATCH):
                    part = slice(k, k + MINIBATCH)
                    some, target = [r[part] for r in rows], bucket[part]
                    kind, each = target >> 4, np.arange(len(target))
                    within = [own.inner_row(r, kind) for r in some]
                    a, b, _ = own.forward(some, target, within)
                    a[each, kind] -= 1
                    b[each, target & 15] -= 1
                    for r, w in zip(some, within):
                        _descend(own.classes, squares[0], r, a)
                        _descend(own.inner, squares[1], w, b)
                seen += len(codes)
        # Changes travel with half precision; they are a few units at most.
        blocks = np.array_split(own.flat() - model.value.flat(), BLOCKS)
        shard = group.column("_shard")[0].as_py() if group.num_rows else 0
        return pa.table(
            {"_shard": pa.array([shard] * BLOCKS, pa.int64()), "_block": pa.array(range(BLOCKS), pa.int32()), "_seen": pa.array([float(seen)] * BLOCKS), "_weights": pa.array([x.astype(np.float16).tobytes() for x in blocks], pa.binary())}
        )

    return run


def _add(group: pa.Table) -> pa.Table:
    """The average of some changes, weighed by the tokens seen."""
    seen = group.column("_seen").to_numpy()
    total = np.zeros(0, dtype=np.float32)
    for x, n in zip(group.column("_weights"), seen / seen.sum()):
        part = np.frombuffer(x.as_buffer(), dtype=np.float16) * np.float32(n)
        total = total + part if len(total) else part
    shard, block = group.column("_shard")[0].as_py(), group.column("_block")[0].as_py()
    return pa.table({"_shard": pa.array([shard // FAN_IN], pa.int64()), "_block": pa.array([block], pa.int32()), "_seen": pa.array([math.fsum(seen)]), "_weights": pa.array([total.astype(np.float16).tobytes()], pa.binary())})


_PART = "_shard long, _block int, _seen double, _weights binary"


def _averaged(parts: DataFrame, shards: int, model: Model) -> Model:
    """The average by token of all shards' weights, added up at most FAN_IN at a time."""
    while True:
        parts = saved(parts.withColumn("_up", F.floor(F.col("_shard") / FAN_IN)).groupBy("_up", "_block").applyInArrow(lambda t: _add(t.drop_columns(["_up"])), _PART))
        shards = math.ceil(shards / FAN_IN)
        if shards <= 1:
            break
    rows = sorted(parts.select("_block", "_weights").collect())
    if not rows:
        return model
    change = np.concatenate([np.frombuffer(r["_weights"], dtype=np.float16) for r in rows]).astype(np.float32)
    return model.with_flat(model.flat() + change)


def _score(model, sizes: np.ndarray) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        share = np.log10(sizes)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 64):
                codes, starts = _tokens(batch.column(1).slice(lo, 64))
                rows = own.features(codes, starts)
                bucket = _BUCKET_OF[codes]
                logs = np.concatenate([own.forward([r[k : k + MINIBATCH] for r in rows], bucket[k : k + MINIBATCH])[2] for k in range(0, len(codes), MINIBATCH)])
                out[lo : lo + len(starts)] = np.add.reduceat(logs.astype(np.float64) / math.log(10) - share[bucket], starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["_row", "_model"])

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of `docs`.

    `held_out` marks the rows that do not train.  `base_score` is the smoothed
    unigram log10 probability, `score` that of the model.  Words are lowered
    (A-Z) and an end follows them.

    A null or empty text is its end alone.  A null id keeps its row (its hash
    is that of the empty id).  Repeated rows train and score each on its own.
    Equal counts (ties) rank tokens by their hash.  Very long texts are scored
    whole.  Without training rows every count is 0 and the model is uniform.
    Other columns are ignored; an empty table gives an empty result.
    """
    return fit(docs, held_out, id_col, text_col)[0]


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """The result of `score_texts`, and the model that gives it."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), held_out.alias("_held"), column(text_col).alias("_text"))
    counted = rows.where("not _held").select("_text").mapInArrow(_count, "h long, c long")
    vocabulary = saved(counted.groupBy("h").agg(F.sum("c").alias("c")))
    # Tokens are ranked by the step that their count falls into: a few hundred rows, and no sort.
    step = F.floor(F.log2("c") * STEPS)
    held, least = 0, None
    for b, n in sorted(vocabulary.groupBy(step.alias("b")).count().collect(), reverse=True):
        if held + n > HEAD:
            break
        held, least = held + n, b
    top = vocabulary.where(step >= least if least is not None else F.lit(False)).toArrow()
    keys, counts = top.column("h").to_numpy().view(U64), top.column("c").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    # Counts of each shared code, less those of the tokens with a code of their own.
    held_by = np.zeros(CODES)
    total, distinct = 0, 0
    shared = OWN_CODES + F.pmod(F.shiftrightunsigned("h", 48), F.lit(CODES - OWN_CODES)).cast("int")
    for code, c, v in vocabulary.groupBy(shared.alias("b")).agg(F.sum("c"), F.count("*")).collect():
        held_by[code] += c + SMOOTH * v
        total, distinct = total + c, distinct + v
    codes = _shared_code(keys)
    own = np.argsort(-counts, kind="stable")[:OWN_CODES]
    np.subtract.at(held_by, codes[own], counts[own] + SMOOTH)
    codes[own] = np.arange(len(own))
    held_by[codes[own]] += counts[own] + SMOOTH
    sizes = SMOOTH + np.bincount(_BUCKET_OF, weights=np.maximum(held_by, 0), minlength=BUCKETS)
    head = spark.sparkContext.broadcast((keys, np.log10(counts + SMOOTH), codes))

    looked = rows.mapInArrow(
        _look_up(head),
        f"_id {kind}, _held boolean, n_tokens long, _sum double, _known long, _rare array<long>, _times array<int>, _codes binary",
    )
    looked = saved(looked.withColumn("_row", F.monotonically_increasing_id()))

    tables = Tables.of(total)
    model = Model(sizes / sizes.sum(), tables)
    shards = max(1, math.ceil(total / (SHARD_TOKENS * tables.inner)))
    for k in range(min(ROUNDS, shards)):
        dealt = looked.where("not _held").select("_codes", F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"))
        mine = dealt.where(F.col("_shard") % ROUNDS == k)
        common = spark.sparkContext.broadcast(model)
        parts = saved(mine.groupBy("_shard").applyInArrow(_train(common), _PART))
        model = _averaged(parts, shards, model)

    final = spark.sparkContext.broadcast(model)
    modelled = looked.select("_row", "_codes").mapInArrow(_score(final, sizes), "_row long, _model double")
    # Tokens beyond the most frequent ones: distinct in each document, so no key is hot.
    rare = looked.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("h"), F.col("x._times").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    found = rare.join(vocabulary, "h", "left").groupBy("_row").agg(F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("_more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_more_known"))
    whole = looked.drop("_rare", "_times", "_codes").join(modelled, "_row").join(found, "_row", "left")
    base = F.col("_sum") + F.coalesce("_more", F.lit(0.0))
    out = whole.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        "n_tokens",
        (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(math.log10(total + SMOOTH * (distinct + 1)))).alias("base_score"),
        (base + F.col("_model")).alias("score"),
    )
    return out, model


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), is_held_out(F.col("doc_id")))


QUERIES = {"op6_lm_score": op6_lm_score}
ORACLES: dict[str, str] = {}
