"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of 32-bit numbers make all coordinates of a signature: the
first scatters a shingle, the second, circularly shifted by k, ranks it for
coordinate k.  Signatures are cut into bands; documents that agree in a band
share a bucket.

Documents with equal shingle sets are one class, and only classes are
compared.  A bucket is not expanded into pairs.  Its members are compared with
its pivot, the member that shares buckets with most others (the original of a
group of edited copies does), and verified links are contracted into
components.  Where a bucket then has members outside its pivot's component,
these are held against all members of the pivot's group in blocks: a task gets
two bounded blocks, compares them as matrices, and passes on no more links
than it takes to connect them.  Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Slice, column, compacted, mix64, saved, slices, table
from .graph import components

SHINGLE = 5

#: Coordinates of a signature, and more where a low similarity asks for them.
COORDINATES = 128

#: A pair as similar as asked shares no band with at most this probability,
MISS_BAND = 1e-7
#: and agrees in fewer coordinates than are asked with at most this one.
MISS_AGREE = 1e-11


@dataclass(frozen=True)
class Plan:
    """How signatures are cut into bands, and in how many coordinates a pair must agree to be verified."""

    coordinates: int
    bands: int
    rows: int
    agreements: int

    @classmethod
    def of(cls, percent: float) -> Plan:
        s = percent / 100
        if not 0 < s <= 1:
            raise ValueError("percent must be above 0 and at most 100")
        size = COORDINATES if s == 1 else max(COORDINATES, math.ceil(math.log(MISS_BAND) / math.log(1 - s)))
        rows = next(r for r in range(8, 0, -1) if r == 1 or (1 - s**r) ** (size // r) <= MISS_BAND)
        below, least = 0.0, 0
        while least < size:
            log = math.lgamma(size + 1) - math.lgamma(least + 1) - math.lgamma(size - least + 1)
            below += math.exp(log + least * math.log(s) + (size - least) * math.log(1 - s)) if s < 1 else 0.0
            if below > MISS_AGREE:
                break
            least += 1
        return cls(size, size // rows, rows, least)


#: Members on either side of a comparison in blocks, on average.
LEFT_BLOCK, RIGHT_BLOCK = 256, 1024

#: A pivot with more partners is verified in several groups of about so many.
PARTNERS = 512


def shingles(piece: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's rows: (hashes sorted within rows, row of each, count by row)."""
    words, row = piece.word_hashes()
    n = np.bincount(row, minlength=piece.rows)
    first = np.cumsum(n) - n
    hashes = np.zeros(len(words), dtype=U64)
    ahead = np.arange(len(words)) - first[row]
    left = n[row] - ahead
    for k in range(size):
        # A row of fewer words is one shingle: the whole sequence.
        has = k < left
        hashes[has] += mix64(words[np.flatnonzero(has) + k], 100 + k)
    keep = (left >= size) | (ahead == 0)
    hashes, row = mix64(hashes[keep], 3), row[keep]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[fresh], row[fresh]
    return hashes, row, np.bincount(row, minlength=piece.rows)


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash signatures, a row for each set that begins at `starts`."""
    scattered = (mix64(hashes, 11) >> U64(32)).astype(np.uint32)  # the first permutation
    out = np.empty((len(starts), coordinates), dtype=np.uint32)
    x, y = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(coordinates):
        # The second permutation, shifted circularly by k.
        np.add(scattered, np.uint32(k), out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor:
                np.multiply(x, np.uint32(factor), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def _digests(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, the same in any order of its members."""
    out = []
    for seed in (21, 22):
        total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix64(hashes, seed), dtype=U64)])
        ends = np.searchsorted(row, np.arange(rows), side="right")
        starts = np.searchsorted(row, np.arange(rows), side="left")
        out.append(mix64(total[ends] - total[starts], seed).view(np.int64))
    return out[0], out[1]


def _sign(coordinates: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                hashes, row, n = shingles(piece)
                hi, lo = _digests(hashes, row, piece.rows)
                grid = np.zeros((piece.rows, coordinates), dtype=np.uint32)
                if len(hashes):
                    full = np.flatnonzero(n)
                    grid[full] = signatures(hashes, (np.cumsum(n) - n)[full], coordinates)
                ids = batch.column(0).slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(hi), pa.array(lo), _binary(grid)], names=["_id", "_n", "_hi", "_lo", "_sig"])

    return run


def _bands(plan: Plan) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                grid = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype=np.uint32).reshape(-1, plan.coordinates)
                grid = grid[:, : plan.bands * plan.rows].reshape(-1, plan.bands, plan.rows).astype(U64)
                key = np.zeros(grid.shape[:2], dtype=U64)
                for r in range(plan.rows):
                    key = mix64(key ^ grid[:, :, r], 31 + r)
                key = mix64(key + np.arange(plan.bands, dtype=U64), 37)
                nodes = np.repeat(some.column(0).to_numpy(), plan.bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return run


def _agree(plan: Plan) -> Callable:
    """Pairs whose signatures agree enough, from (a, b, sig_a, sig_b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), dtype=np.uint32).reshape(-1, plan.coordinates) for c in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= plan.agreements)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(keep)

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) for rows (node, hi, lo, text) whose set has the digest (hi, lo)."""
    for batch in batches:
        for piece in slices(batch.column(3)):
            hashes, row, n = shingles(piece)
            hi, lo = _digests(hashes, row, piece.rows)
            some = batch.slice(piece.first, piece.rows)
            same = (some.column(1).to_numpy() == hi) & (some.column(2).to_numpy() == lo)
            ends = np.cumsum(n)
            held = [hashes[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(held, pa.binary())], names=["node", "set"]).filter(pa.array(same))


def _verify(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                shared = int((q[at] == p).sum())
                keep.append(100 * shared >= least * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set) of some classes, from the text of a document of each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "_hi", "_lo", F.col("_first").alias("_id"))
    rows = docs.join(wanted, docs["_id"].eqNullSafe(wanted["_id"])).select("node", "_hi", "_lo", "_text")
    # One of several rows that hold the same set is enough.
    return saved(rows.mapInArrow(_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    known = classes.select("node", "_n", "_sig")
    x = known.select(F.col("node").alias("a"), F.col("_n").alias("na"), F.col("_sig").alias("sa"))
    y = known.select(F.col("node").alias("b"), F.col("_n").alias("nb"), F.col("_sig").alias("sb"))
    sized = (100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))
    close = pairs.join(x, "a").join(y, "b").where(sized).select("a", "b", "sa", "sb").mapInArrow(_agree(Plan.of(percent)), "a long, b long")
    close = compacted(close)
    sets = _full_sets(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), classes, docs)

    # Pivots have many partners: their set is copied for each group of about PARTNERS of them.
    groups = close.groupBy("b").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("_groups"))
    dealt = close.join(groups, "b").withColumn("_group", F.pmod(F.xxhash64("a"), F.col("_groups")).cast("int")).select("a", "b", "_group")
    right = sets.join(groups, sets["node"] == groups["b"]).select("b", F.col("set").alias("set_b"), F.explode(F.expr("sequence(0, _groups - 1)")).alias("_group"))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    return dealt.join(right, ["b", "_group"]).select("a", "b", "set_b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deal members (pivot, node, root, inside, ...) into pairs of blocks (pivot, i, j, left, ...).

    Left blocks hold the members outside the pivot's component, right blocks all.
    """
    sizes = members.groupBy("pivot").agg(
        F.ceil(F.count(F.when(~F.col("inside"), 1)) / F.lit(LEFT_BLOCK)).cast("int").alias("_lefts"),
        F.ceil(F.count("*") / F.lit(RIGHT_BLOCK)).cast("int").alias("_rights"),
    ).where("_lefts > 0")
    sized = members.join(sizes, "pivot")
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    left = sized.where("not inside").withColumn("i", F.pmod(own, F.col("_lefts"))).withColumn("j", F.explode(F.expr("sequence(0, _rights - 1)"))).withColumn("left", F.lit(True))
    right = sized.withColumn("j", F.pmod(own, F.col("_rights"))).withColumn("i", F.explode(F.expr("sequence(0, _lefts - 1)"))).withColumn("left", F.lit(False))
    kinds = {"i": "long", "j": "long"}
    left, right = (x.withColumns({k: F.col(k).cast(v) for k, v in kinds.items()}) for x in (left, right))
    return left.unionByName(right).drop("_lefts", "_rights")


def _sides(group: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Left and right members, and which pairs are of different components and of compatible size."""
    side = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
    left, right = group.filter(pa.array(side)), group.filter(pa.array(~side))
    x, y = (t.column("root").to_numpy() for t in (left, right))
    return left, right, x[:, None] != y[None, :]


def _alive(percent: int):
    """The members of two blocks with a partner whose size and signature may do."""

    plan = Plan.of(percent)

    def run(group: pa.Table) -> pa.Table:
        left, right, may = _sides(group)
        n, m = (t.column("_n").to_numpy().astype(np.int64) for t in (left, right))
        may &= 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
        x, y = (np.frombuffer(b"".join(t.column("_sig").to_pylist()), dtype=np.uint32).reshape(-1, plan.coordinates) for t in (left, right))
        for i in np.flatnonzero(may.any(axis=1)):
            at = np.flatnonzero(may[i])
            may[i, at] = (y[at] == x[i]).sum(axis=1) >= plan.agreements
        nodes = np.unique(np.concatenate([left.column("node").to_numpy()[may.any(axis=1)], right.column("node").to_numpy()[may.any(axis=0)]]))
        return pa.table({"pivot": pa.array(np.full(len(nodes), group.column("pivot")[0].as_py(), dtype=np.int64)), "node": pa.array(nodes)})

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all `linked` (left x right) pairs connect, fewer than there are members."""
    out = []
    left_new, right_new = linked.any(axis=1), linked.any(axis=0)
    while left_new.any():
        wave = np.array([int(np.argmax(left_new))])
        left_new[wave] = False
        while len(wave):
            reached = np.flatnonzero(linked[wave].any(axis=0) & right_new)
            right_new[reached] = False
            out += zip(wave[np.argmax(linked[np.ix_(wave, reached)], axis=0)].tolist() if len(reached) else [], reached.tolist())
            wave = np.flatnonzero(linked[:, reached].any(axis=1) & left_new) if len(reached) else reached
            left_new[wave] = False
            out += zip(wave.tolist(), reached[np.argmax(linked[np.ix_(wave, reached)], axis=1)].tolist() if len(wave) else [])
    return out


def _connect(percent: int):
    """Links between two blocks, by exact intersections of all their sets."""

    def run(group: pa.Table) -> pa.Table:
        left, right, may = _sides(group)
        sets = [[np.frombuffer(v.as_buffer(), dtype=U64) for v in t.column("set").combine_chunks()] for t in (left, right)]
        n, m = (np.array([len(v) for v in side], dtype=np.int64) for side in sets)
        shared = np.zeros(may.shape, dtype=np.float32)
        if len(n) and len(m):
            # Only shingles that both sides hold count; they are taken some at a time.
            x, y = (np.concatenate(side) for side in sets)
            both = np.intersect1d(x, y)
            for lo in range(0, len(both), 4096):
                some = both[lo : lo + 4096]
                grids = []
                for flat, sizes in ((x, n), (y, m)):
                    at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
                    hit = some[at] == flat
                    grid = np.zeros((len(sizes), len(some)), dtype=np.float32)
                    grid[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
                    grids.append(grid)
                shared += grids[0] @ grids[1].T
        count = np.rint(shared).astype(np.int64)
        linked = may & (100 * count >= percent * (n[:, None] + m[None, :] - count))
        a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
        pairs = _forest(linked)
        return pa.table({"a": pa.array(a[[i for i, _ in pairs]].astype(np.int64)), "b": pa.array(b[[j for _, j in pairs]].astype(np.int64))})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, n_shingles, component_id, kept), a row for each row of `docs`.

    Documents are linked if 100 * intersection >= percent * union of their
    sets of distinct word 5-grams (A-Z lowered; a text of fewer words is one
    shingle).  `component_id` is the smallest id that links reach, and `kept`
    says that a document has this id.

    A null or blank text has no shingles and is linked with nothing, not even
    with another such text.  A null id is greater than all others: it is a
    component's id only if all its ids are null.  Repeated rows, and different
    texts under one id, are documents of their own; if one is kept, so are the
    others with its id in the component (ties).  Very long texts are one set
    each, whole.  Other columns are ignored; an empty table gives an empty
    result.

    `percent` may be any number above 0: bands, and the agreement that a pair
    needs to be verified, follow from it.  A link is missed with a probability
    of at most MISS_BAND + MISS_AGREE.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    signed = saved(rows.mapInArrow(_sign(Plan.of(percent).coordinates), f"_id {kind}, _n long, _hi long, _lo long, _sig binary"))
    classes = (
        signed.where("_n > 0")
        .groupBy("_hi", "_lo", "_n")
        .agg(F.min("_id").alias("_first"), F.first("_sig").alias("_sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = saved(classes)
    roots = _cluster(classes, rows, percent)
    rooted = classes.join(roots, "node", "left").select("_hi", "_lo", "_n", "_first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(least, "root").select("_hi", "_lo", "_n", "component_id")
    out = signed.select("_id", "_hi", "_lo", "_n").join(named, ["_hi", "_lo", "_n"], "left")
    component = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _cluster(classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that have links."""
    bands = classes.select("node", "_sig").mapInArrow(_bands(Plan.of(percent)), "key long, node long")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = compacted(bands.join(sizes, "key"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    placed = shared.join(weights, "node")
    pivots = placed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("b"))
    pairs = shared.join(pivots, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    tested = compacted(pairs)
    found = compacted(_links(tested, classes, rows, percent))
    roots = components(found)

    # Members of a bucket that are outside its pivot's component meet the members of the pivot's group.
    root = F.coalesce("root", "node")
    marked = shared.select("key", "node").join(roots, "node", "left").select("key", "node", root.alias("root"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rest = marked.join(mixed, "key", "left_semi").join(pivots, "key").select(F.col("b").alias("pivot"), "node", "root").distinct()
    tops = roots.select(F.col("node").alias("pivot"), F.col("root").alias("top"))
    rest = rest.join(tops, "pivot", "left").withColumn("inside", F.col("root") == F.coalesce("top", "pivot")).drop("top")
    rest = compacted(rest)
    if rest.isEmpty():
        return roots
    signed = rest.join(classes.select("node", "_n", "_sig"), "node")
    alive = _in_blocks(signed).groupBy("pivot", "i", "j").applyInArrow(lambda t: _alive(percent)(t), "pivot long, node long").distinct()
    alive = compacted(rest.join(alive, ["pivot", "node"], "left_semi"))
    sets = _full_sets(alive.select("node").distinct(), classes, rows)
    more = _in_blocks(alive.join(sets, "node")).groupBy("pivot", "i", "j").applyInArrow(lambda t: _connect(percent)(t), "a long, b long")
    more = compacted(more.distinct())
    if more.isEmpty():
        return roots
    # The new links join components that are known already.
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab")
    lifted = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    above = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root")))


def keep_one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns, whatever their names: that with the smallest id.

    A null id is greater than all others.  Of a group's rows with one id, also
    a null one, the one whose text has the smallest digest stays; of rows that
    repeat an id and its text, any one.  Null, empty and very long texts are
    as in `near_duplicates`; an empty table gives an empty result.
    """
    # An id and a text's digest together tell apart what the id alone does not.
    digest = F.sha2(F.coalesce(column(text_col), F.lit("")), 256)
    mark = F.struct(column(id_col).isNull().alias("n"), column(id_col).alias("id"), column(text_col).isNull().alias("t"), digest.alias("h"))
    judged = near_duplicates(docs.select(mark.alias("_key"), column(text_col).alias("_body")), percent, "_key", "_body")
    kept = judged.where("kept").select(F.col("_key").alias("_kept")).distinct()
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row"), mark.alias("_mark"))
    return rows.join(kept, F.col("_mark").eqNullSafe(F.col("_kept"))).dropDuplicates(["_mark"]).select("_row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words WHERE w IS NOT NULL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), parts AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN parts USING (doc_id)
"""

QUERIES = {"op2_minhash": op2_minhash}
ORACLES = {"op2_minhash": OP2_SQL}
