"""Phrase collocation mining by vertical partitioning of the suffixes of word sequences.

Each place of a text has the suffix of at most four words that starts there and
ends with its piece.  Word prefixes are counted first, by depth: a prefix with
more occurrences than the memory budget is extended by a word, and only its
extensions are counted next.  The prefixes at which this stops are packed into
groups that hold the budget together, and every suffix goes to the group of its
prefix.  A group's suffixes, sorted, are the leaves of its subtrees cut at four
words; the count of a phrase is the total of the leaves below its node.  Each
group and language is built by itself, in memory that the budget bounds.

Equal suffixes of a slice of texts are one leaf with a count, so a phrase that
every text has does not fill its group, and the leaves of a slice in a group
are one row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, U64, Slice, column, distinct_spans, equal_spans, hash_spans, mix64, saved, slices, table

LONGEST = 4
LEAST = 30
TOP = 2000
#: Share of its count, in hundredths, that a longer phrase has to have to make a shorter one superfluous.
WITHIN = 80

#: The whole is cut into so many groups, so that a slice of texts gives a
#: group's row for each of them and language at most, however much there is;
#: groups have no fewer occurrences than the first budget, and no more than the
#: second (some 100 MB of leaves), beyond which there are more groups.
GROUPS = 512
BUDGETS = (1 << 14, 1 << 22)
#: Groups, and prefixes above the budget at a depth, that the driver sees at most.
MOST_GROUPS = 1 << 18

#: Bytes of text whose equal suffixes become one leaf, and whose equal prefixes become one row.
SLICE = 1 << 21
SLICE_OF_PREFIXES = 1 << 20

_CUTS = np.zeros(256, dtype=bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


class Words:
    """The words of a slice: hashes of the prefixes of each place's suffix, and the words left in its piece."""

    def __init__(self, part: Slice, langs: pa.Array) -> None:
        self.data = TO_LOWER[part.data]
        cuts = _CUTS[self.data]
        self.starts, self.ends = part.runs(~(cuts | _BLANK[self.data]))
        rows = part.row_of(self.starts)
        encoded = langs.dictionary_encode()
        self.langs = encoded.dictionary
        self.lang = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
        data, offsets = _bytes(self.langs)
        self._of_lang = mix64(hash_spans(data, offsets[:-1], offsets[1:]), 21) if len(self.langs) else np.zeros(0, dtype=U64)
        n = len(self.starts)
        self.left = np.ones(n, dtype=np.int8)
        if n:
            piece = np.cumsum(cuts, dtype=np.int32)[self.starts]
            joined = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
            for _ in range(LONGEST - 1):
                self.left[:-1] = np.where(joined, np.minimum(self.left[1:] + 1, LONGEST), 1)
        self.own = hash_spans(self.data, self.starts, self.ends)
        self.places = np.arange(n)

    def hashes(self, depth: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the language and the `depth` words from the places `at` on."""
        if not len(at):
            return np.zeros(0, dtype=U64)
        out = mix64(self.own[at] ^ self._of_lang[self.lang[at]], 22)
        for k in range(1, depth):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + self.own[at + k], 22 + k)
        return out

    @functools.cached_property
    def word(self) -> np.ndarray:
        """The number of each word."""
        return distinct_spans(self.data, self.starts, self.ends)[0]

    def distinct(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of the places `at` for each content of `depth` words from it on, ordered by their numbers, and how many places have it."""
        bits = max(1, int(self.word.max(initial=0)).bit_length())
        number, held = self.lang[at], max(1, len(self.langs)).bit_length()
        for k in range(depth):
            if held + bits > 63:
                number = np.unique(number, return_inverse=True)[1]
                held = max(1, len(at)).bit_length()
            number = (number << bits) | self.word[at + k]
            held += bits
        _, one, count = np.unique(number, return_index=True, return_counts=True)
        return at[one], count

    def text(self, at: np.ndarray, depth: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The `depth` words from each place on, as bytes and offsets: a space between words and `end` after the last."""
        owner = np.repeat(np.arange(len(at)), depth)
        first = np.cumsum(depth) - depth
        word = at[owner] + np.arange(len(owner)) - first[owner]
        size = self.ends[word] - self.starts[word]
        total = size + 1
        total[first + depth - 1] += len(end) - 1
        begin = np.cumsum(total) - total
        data = np.full(int(total.sum()), 0x20, dtype=np.uint8)
        inside = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        data[step + np.repeat(begin - inside, size)] = self.data[step + np.repeat(self.starts[word] - inside, size)]
        offsets = np.concatenate([begin[first], [len(data)]]).astype(np.int64)
        for k, b in enumerate(end):
            data[offsets[1:] - len(end) + k] = b
        return data, offsets

    def lang_of(self, at: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang[at])).cast(pa.string())


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


class Partition:
    """Which prefixes are extended (hashes by depth), and the group of each bucket."""

    def __init__(self) -> None:
        self.heavy: list[np.ndarray] = []
        #: By the low bits of a prefix's hash.
        self.group = np.zeros(1, dtype=np.int32)

    def cut(self, words: Words) -> np.ndarray:
        """The depth of the prefix by which each suffix is grouped; more than its words if even all of them are too many."""
        cut = np.ones(len(words.left), dtype=np.int8)
        on = words.places
        for depth, heavy in enumerate(self.heavy):
            on = on[words.left[on] > depth]
            on = on[_member(words.hashes(depth + 1, on), heavy)]
            cut[on] += 1
        return cut

    def group_of(self, words: Words, at: np.ndarray, cut: np.ndarray) -> np.ndarray:
        group = np.zeros(len(at), dtype=np.int32)
        for depth in range(1, LONGEST + 1):
            own = np.flatnonzero(cut == depth)
            group[own] = self.group[(words.hashes(depth, at[own]) & U64(len(self.group) - 1)).astype(np.int64)]
        return group


def _mapped(docs: DataFrame, rows: Callable[[Words], list[pa.Array]], schema: pa.Schema, ddl: str, limit: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), limit):
                yield pa.RecordBatch.from_arrays(rows(Words(part, batch.column(0).slice(part.first, part.rows))), schema=schema)

    return docs.mapInArrow(run, ddl)


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("_h", pa.int64()), ("_n", pa.int64())])
_COUNTS_DDL = "lang string, phrase string, _h long, _n long"


def prefix_counts(docs: DataFrame, depth: int, partition: Partition) -> DataFrame:
    """(lang, phrase, _h, f) of the prefixes of `depth` words that extend one with too many occurrences."""

    def rows(words: Words) -> list[pa.Array]:
        at = np.flatnonzero((words.left >= depth) & (partition.cut(words) >= depth))
        one, count = words.distinct(depth, at)
        text = _strings(*words.text(one, np.full(len(one), depth), b"")).cast(pa.string())
        return [words.lang_of(one), text, pa.array(words.hashes(depth, one).view(np.int64)), pa.array(count)]

    return _mapped(docs, rows, _COUNTS, _COUNTS_DDL, SLICE_OF_PREFIXES).groupBy("lang", "phrase", "_h").agg(F.sum("_n").alias("f"))


_LEAVES = pa.schema([("_group", pa.int32()), ("lang", pa.string()), ("_leaves", pa.binary()), ("_cuts", pa.binary()), ("_counts", pa.binary())])
_LEAVES_DDL = "_group int, lang string, _leaves binary, _cuts binary, _counts binary"
_END = b" \n"


def leaves(docs: DataFrame, partition: Partition) -> DataFrame:
    """The distinct suffixes of each slice by group and language: texts, depths of their prefixes, and counts, packed.

    Each word of a suffix is followed by a space, and each suffix by a line end.
    """

    def rows(words: Words) -> list[pa.Array]:
        cut = partition.cut(words)
        found = [words.distinct(depth, np.flatnonzero((words.left == depth) & (cut <= depth))) for depth in range(2, LONGEST + 1)]
        at, count = (np.concatenate(x) for x in zip(*found))
        depth = np.repeat(np.arange(2, LONGEST + 1), [len(x[0]) for x in found])
        group = partition.group_of(words, at, cut[at])
        order = np.lexsort((words.lang[at], group))
        at, count, depth, group = at[order], count[order], depth[order], group[order]
        lang = words.lang[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (lang[1:] != lang[:-1])
        first = np.flatnonzero(new)
        edges = np.concatenate([first, [len(at)]])
        data, offsets = words.text(at, depth, _END)
        return [
            pa.array(group[first]),
            words.lang_of(at[first]),
            _packed(data, offsets[edges]),
            _packed(cut[at].astype(np.uint8), edges),
            _packed(count.astype("<i4").view(np.uint8), 4 * edges),
        ]

    return _mapped(docs, rows, _LEAVES, _LEAVES_DDL, SLICE)


_NODES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def subtree(packed: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, f) of the nodes of a group at or below its prefixes with `least` occurrences or more."""
    data = np.frombuffer(b"".join(packed.column("_leaves").to_pylist()), dtype=np.uint8)
    cuts = np.frombuffer(b"".join(packed.column("_cuts").to_pylist()), dtype=np.uint8)
    counts = np.frombuffer(b"".join(packed.column("_counts").to_pylist()), dtype="<i4")
    ends = np.flatnonzero(data == 0x0A) + 1
    encoded = _strings(data, np.concatenate([[0], ends])).dictionary_encode()
    same = encoded.indices.to_numpy()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    texts, offsets = _bytes(encoded.dictionary.take(pa.array(order)))
    total = np.bincount(same, weights=counts).astype(np.int64)[order]
    cut = np.zeros(len(order), dtype=np.uint8)
    cut[same] = cuts
    cut = cut[order]
    spaces = np.flatnonzero(texts == 0x20)
    first = np.searchsorted(spaces, offsets)
    phrases, found = [], []
    for depth in range(2, LONGEST + 1):
        at = np.flatnonzero((np.diff(first) >= depth) & (cut <= depth))
        if not len(at):
            continue
        # Leaves that begin with the same words stand together.
        start, end = offsets[at], spaces[first[at] + depth - 1]
        new = np.ones(len(at), dtype=bool)
        new[1:] = ~equal_spans(texts, start[1:], end[1:], start[:-1], end[:-1])
        begin = np.flatnonzero(new)
        f = np.add.reduceat(total[at], begin)
        for k in np.flatnonzero(f >= least).tolist():
            phrases.append(texts[start[begin[k]] : end[begin[k]]].tobytes().decode())
            found.append(int(f[k]))
    lang = packed.column("lang")[0].as_py() if packed.num_rows else None
    return pa.Table.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.string()), pa.array(found, pa.int64())], schema=_NODES)


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, f) of all phrases of up to four words with `least` occurrences, (lang, n), and the budget taken.

    `docs` has the columns text and lang (never null).  The driver sees hashes
    of prefixes above the budget, MOST_GROUPS a depth at most, and the totals of the
    buckets.
    """
    partition = Partition()
    words = saved(prefix_counts(docs, 1, partition))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    whole = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget or min(max(whole // GROUPS, BUDGETS[0]), BUDGETS[1]), least, whole // MOST_GROUPS)
    # Prefixes are packed by buckets of their hash, 8 to 16 for a group.
    buckets = 1 << int(8 * (whole // budget + 1)).bit_length()
    weight = np.zeros(buckets, dtype=np.int64)
    bucket = F.col("_h").bitwiseAND(F.lit(buckets - 1)).cast("int")
    counted, known = words, [words.where(F.col("f") >= least)]
    for depth in range(1, LONGEST):
        over = counted.where(F.col("f") > budget)
        hashes = over.select("_h").distinct()
        heavy = np.sort(np.array([r[0] for r in hashes.collect()], dtype=np.int64).view(U64))
        for r in counted.join(F.broadcast(hashes), "_h", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("f").alias("f")).collect():
            weight[r["bucket"]] += r["f"]
        if not len(heavy):
            break
        partition.heavy.append(heavy)
        if depth > 1:
            known.append(counted.join(F.broadcast(hashes), "_h", "left_semi").where(F.col("f") >= least))
        if depth + 1 < LONGEST:
            counted = saved(prefix_counts(docs, depth + 1, partition))
        else:
            # What follows is whole suffixes, one row of a slice each, which their hash spreads over all groups.
            weight += over.agg(F.sum("f")).first()[0] // buckets
    partition.group = (np.cumsum(weight) // budget).astype(np.int32)
    counts = leaves(docs, partition).groupBy("_group", "lang").applyInArrow(lambda packed: subtree(packed, least), "lang string, phrase string, f long")
    for more in known:
        counts = counts.unionByName(more.select("lang", "phrase", "f"))
    return saved(counts), totals, budget


def _looked_up(wanted: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """`wanted` (lang, part, ...) with f, the count of each part.

    Parts with more occurrences than the budget, which many phrases may have,
    are 4 * MOST_GROUPS at most and go to every task; any other part is wanted
    by fewer phrases than it occurs.
    """
    counts = counts.withColumnRenamed("phrase", "part")
    frequent = wanted.join(F.broadcast(counts.where(F.col("f") > budget)), ["lang", "part"], "left")
    rest = frequent.where("f is null").drop("f").join(counts.where(F.col("f") <= budget), ["lang", "part"])
    return frequent.where("f is not null").unionByName(rest)


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(24,0)")


def scored(counts: DataFrame, budget: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more, at the lowest-scoring cut."""
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("_w")).where(F.size("_w") > 1)

    def cut(k: Column) -> Column:
        parts = [("l", F.slice("_w", F.lit(1), k)), ("r", F.slice("_w", k + 1, F.size("_w") - k))]
        return F.array(*(F.struct(k.alias("k"), F.lit(side).alias("side"), F.array_join(p, " ").alias("part")) for side, p in parts))

    wanted = phrases.select("lang", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w") - 1), cut))).alias("_p")).select("lang", "phrase", "a", "_p.*")
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, LONGEST) for side in "lr"]
    table_ = _looked_up(wanted, counts, budget).groupBy("lang", "phrase", "a").agg(*sides)
    score = "cast(2000000 * cast(a as decimal(24,0)) div cast(l{k} + r{k} as decimal(24,0)) as long)"
    cuts = F.filter(F.array(*(F.struct(F.expr(score.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, LONGEST))), lambda c: c["l"].isNotNull())
    return table_.select("lang", "phrase", "a", F.array_min(cuts).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")


def not_within_longer(phrases: DataFrame, within: int = WITHIN) -> DataFrame:
    """Phrases (lang, phrase, a, ...) without those whose words lie in a longer one that has `within` hundredths of their count."""
    words = F.split("phrase", " ")
    longer = phrases.select("lang", "a", words.alias("_w")).where(F.size("_w") > 2)

    def inside(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))

    held = longer.select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("_w") - 1), inside))).alias("phrase"), F.col("a").alias("_longer"))
    rest = [c for c in phrases.columns if c not in ("lang", "phrase")]
    both = phrases.unionByName(held, allowMissingColumns=True).groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in [*rest, "_longer"]))
    return both.where(F.col("_longer").isNull() | (100 * _wide("_longer") < within * _wide("a"))).drop("_longer")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, within: int = WITHIN, budget: int | None = None) -> DataFrame:
    """Return (lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces
    and those into words; all counts are of a language, n of its words.  Of
    phrases of two to four words that occur `least` times or more (a), the
    score is that of the lowest-scoring cut, floor(2000000 * a / (l + r)), with
    the counts l and r of its parts (ties: the earliest cut).  A phrase within
    a longer one of at least `within` hundredths of its occurrences is left
    out.  Order: score and a descending, then bytes of the phrase.

    `budget` bounds the occurrences in a group of suffixes (without one, it
    follows from all words, see GROUPS).  A null text is
    empty, a null language is `und`.  Repeated rows count as often as they are
    there; ids are not read.  A text or word of any length is taken whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).cast("string").alias("text"))
    counts, totals, budget = phrase_counts(rows, least, budget)
    phrases = not_within_longer(scored(counts, budget), within)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most of the phrases: the best of each share of it come first.
    shares = phrases.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = shares.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_r") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from worded),
suffixes as (select lang, ws, i, unnest(range(1, 5)) as m from places),
f as (
  select lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') as phrase, m, count(*) as f
  from suffixes where i + m - 1 <= len(ws) group by all
),
n as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30),
cuts as (select *, unnest(range(1, m)) as k from c),
valued as (
  select u.lang, u.phrase, u.a, u.k, x.f as l, y.f as r, ((2000000 * u.a::hugeint) // (x.f + y.f))::bigint as score
  from cuts u
  join f x on x.lang = u.lang and x.phrase = array_to_string(list_slice(u.w, 1, u.k), ' ')
  join f y on y.lang = u.lang and y.phrase = array_to_string(list_slice(u.w, u.k + 1, u.m), ' ')
),
lowest as (select * from valued qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select lang, array_to_string(list_slice(w, i, i + s - 1), ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, m - s + 2)) as i from (select *, unnest(range(2, m)) as s from c where m > 2))
  group by all
),
kept as (
  select v.* from lowest v left join held h on h.lang = v.lang and h.phrase = v.phrase
  where h.longer is null or 100 * h.longer::hugeint < 80 * v.a::hugeint
)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
join n using (lang) where rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES: dict[str, str] = {"op11_collocations": _SQL}
