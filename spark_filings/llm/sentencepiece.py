"""SentencePiece encoding with Gumbel top-k sampling, and decoding.

A text's segmentations are the paths of a lattice whose arcs are vocabulary
pieces.  The k sampled ones are the k with the largest perturbed log
probabilities, which makes them a sample without replacement.  They are found
by A* search from the root down: the best path from a node is drawn arc by arc
with the probabilities that a backward pass gives; what was not taken at each
step is a node whose best value is a Gumbel variable truncated at the value of
the node above; the best such node is opened next.  The value of the next node
that would be opened is the threshold for the inclusion scores.

Pieces never cross certain places (before white space, and wherever no arc
passes), so a text is a row of short independent lattices.  Those of a slice
of texts are found, summed and sampled together with numpy; equal units share
a lattice, but each occurrence draws its own numbers, which depend on the row
key, the place and the sample only.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_LEAD, U64, column, hash_spans, mix64, slices, table

SAMPLES = 2

#: Exponent of the pieces' probabilities in sampling.
ALPHA = 0.6

#: Longer units are cut where no arc passes.
LONG_UNIT = 48

#: Doubles give Gumbel variables between -3.7 and 36.8, so a node whose log
#: mass is lower by more than this than another's cannot have a larger value.
SPREAD = 41.0

#: Bytes of text that share lattices.
SLICE = 3 << 18

_MARK = "▁"


def default_model() -> str:
    """The public 32k model of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model as a trie over bytes; the white space mark is a space byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int32)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(_MARK, " ").encode()
                normal.append((i, -model.get_score(i)))
        # A merge model has ranks for scores; pieces are taken to follow Zipf's law in them.
        rank = np.full(n, 1.0)
        for i, r in normal:
            rank[i] = min(r, n) + 2
        weight = -np.log(rank)
        bytes_at = [int(x) for x in self.byte_id]
        weight[bytes_at] = -np.log(n + 2.0)
        live = [i for i, _ in normal] + bytes_at
        top = weight[live].max()
        self.weight = ALPHA * (weight - top - np.log(np.exp(weight[live] - top).sum()))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, _ in normal:
            at = 0
            for b in self.bytes[i]:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = i
        self.step = np.zeros((len(children), 256), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        for at, kids in enumerate(children):
            for b, to in kids.items():
                self.step[at, b] = to
        self.ends = np.array(ends, dtype=np.int32)
        used = np.zeros(256, dtype=bool)
        inner_space = False
        for i, _ in normal:
            used[list(self.bytes[i])] = True
            inner_space |= b" " in self.bytes[i].lstrip(b" ")
        #: Bytes that no piece holds stand alone.
        self.alone = ~used & (np.arange(256) < 128)
        self.splits_at_space = not inner_space
        self.size = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids as UTF-8, without the leading space that encoding adds."""
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.text[np.arange(len(shift)) + shift].tobytes()[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a run of counts[i] entries for each i: the entry's i, and its number in the run."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Lattices:
    """The lattices of distinct units, laid end to end; places are bytes of `data`."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        limit = np.repeat(ends, ends - starts).astype(np.int32)
        lead = IS_LEAD[data]
        lead[starts] = True
        at = np.flatnonzero(lead).astype(np.int32)
        width = np.zeros(len(data) + 1, dtype=np.int32)
        width[at] = np.diff(np.append(at, len(data)))  # ends of units are starts of others
        found = []
        place, state, depth = at, np.zeros(len(at), dtype=np.int32), 0
        flat_steps = voc.step.ravel()
        while len(place):
            state = flat_steps[state.astype(np.int32) * 256 + data[place + depth]]
            alive = np.flatnonzero(state)
            place, state = place[alive], state[alive]
            depth += 1
            piece = voc.ends[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((place[hit], np.full(len(hit), depth, dtype=np.int32), piece[hit]))
            more = np.flatnonzero(place + depth < limit[place])
            place, state = place[more], state[more]
        none = np.zeros(0, dtype=np.int32)
        start, size, piece = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none)
        del found, place, state, limit
        # A code point that is no piece is spelled in bytes.
        single = np.zeros(len(data) + 1, dtype=bool)
        single[start[size == width[start]]] = True
        bare = at[~single[at]]
        start, size = np.concatenate([start, bare]), np.concatenate([size, width[bare]])
        piece = np.concatenate([piece, np.full(len(bare), -1, dtype=np.int32)])
        end = start + size
        weight = np.where(piece >= 0, voc.weight[piece], voc.weight[voc.byte_id[0]] * size)
        alone = np.flatnonzero((piece < 0) & (size == 1))
        piece[alone] = voc.byte_id[data[start[alone]]]
        crossing = np.cumsum(np.bincount(start + 1, minlength=len(data) + 2) - np.bincount(end, minlength=len(data) + 2))[: len(data) + 1]
        self.is_cut = np.zeros(len(data) + 1, dtype=bool)
        self.is_cut[at] = crossing[at] == 0
        self.is_cut[len(data)] = True
        # Backward sums by distance from the next cut, where they begin anew.
        following = np.full(len(data) + 1, len(data), dtype=np.int32)
        cuts = np.flatnonzero(self.is_cut)
        following[: cuts[-1]] = np.repeat(cuts[1:], np.diff(cuts))[: cuts[-1]] if len(cuts) > 1 and cuts[0] == 0 else len(data)
        away = (following[start] - start).astype(np.int64)
        by = np.argsort((away << 32) | start)
        start, end, piece, weight, away = start[by], end[by], piece[by], weight[by], away[by]
        del crossing, single, width, following, size, by
        beta = np.zeros(len(data) + 1)
        score = np.zeros(len(start))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(away)) + 1, [len(away)]]) if len(away) else np.zeros(1, dtype=np.int64)
        del away
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = start[1:] != start[:-1]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            to = end[lo:hi]
            s = weight[lo:hi] + np.where(self.is_cut[to], 0.0, beta[to])
            score[lo:hi] = s
            first = np.flatnonzero(fresh[lo:hi])
            top = np.maximum.reduceat(s, first)
            n = np.diff(np.append(first, hi - lo))
            beta[start[lo:hi][first]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, n)), first))
        log_p = np.minimum(score - beta[start], 0.0)
        del weight, score, fresh
        # Likely arcs come first, so that a draw looks at few.
        p = np.exp(log_p)
        order = np.argsort(start + (1 - p) * 0.999)
        self.data, self.start, self.end, self.piece, self.log_p = data, start[order], end[order], piece[order], log_p[order]
        p = p[order]
        self.first = np.searchsorted(self.start, np.arange(len(data) + 1))
        total = np.concatenate([[0.0], np.cumsum(p)])
        self.edge = total[1:] - total[self.first[self.start]]
        self.edge[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = 1.0  # a node's last arc

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc out of each node."""
        arc = self.first[node]
        late = np.flatnonzero(self.edge[arc] <= u)
        while len(late):
            arc[late] += 1
            late = late[self.edge[arc[late]] <= u[late]]
        return arc


def _uniform(seed: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only."""
    h = np.asarray(seed, dtype=U64)
    for k, p in enumerate(parts):
        h = mix64(h ^ (np.asarray(p).astype(U64) * U64(0x9E3779B97F4A7C15)), 700 + k)
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _below(value, mass, u) -> np.ndarray:
    """Gumbel variables with location `mass`, truncated at `value`."""
    return -np.logaddexp(-value, -(mass + _gumbel(u)))


def _log_rest(log_p: np.ndarray) -> np.ndarray:
    """Log of what is left beside an arc; minus infinity where nothing is."""
    return np.log1p(-np.exp(log_p), where=log_p < 0, out=np.full(len(log_p), -np.inf))


class Path:
    """One segmentation: that of a stream, or another one's up to a step and then its own.

    `own` are the arcs in the occurrence `at` from step `split` on; later
    occurrences are the stream's.
    """

    def __init__(self, arcs: np.ndarray, value: float, log_p: float, stream: int, parent: Path | None = None, split: int = 0, at: int = 0, own: int = 0) -> None:
        self.arcs, self.value, self.log_p = arcs, value, log_p
        self.stream, self.parent, self.split, self.at, self.own = stream, parent, split, at, own


class Sampler:
    """Samples of all texts of a slice."""

    def __init__(self, voc: Vocabulary, raw: list[bytes], seeds: np.ndarray) -> None:
        self.voc, self.seeds = voc, seeds
        # The white space mark in a text is white space; a space goes before each text.
        texts = [b" " + t.replace(_MARK.encode(), b" ") if t else b"" for t in raw]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        alone = voc.alone[data]
        edge[:-1] |= alone
        edge[1:] |= alone
        if voc.splits_at_space:
            space = data == 32
            edge[1:-1] |= space[1:] & ~space[:-1]
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[:-1], bounds[1:]
        hashes = hash_spans(data, starts, ends)
        _, chosen, kind = np.unique(hashes, return_index=True, return_inverse=True)
        size = (ends - starts)[chosen]
        owner, number = _spread(size)
        unit_end = np.cumsum(size)
        unit_start = unit_end - size
        lat = self.lattices = Lattices(voc, data[starts[chosen][owner] + number], unit_start, unit_end)
        # Long units become several stretches between cuts.
        breaks = lat.is_cut[:-1].copy() if len(size) else np.zeros(0, dtype=bool)
        short = np.repeat(size <= LONG_UNIT, size)
        breaks[short] = False
        breaks[unit_start] = True
        part_start = np.flatnonzero(breaks)
        part_end = np.append(part_start[1:], len(breaks))
        parts = np.searchsorted(part_start, unit_end) - np.searchsorted(part_start, unit_start)
        first_part = np.cumsum(parts) - parts
        which, nth = _spread(parts[kind])
        part = first_part[kind][which] + nth
        self.begin, self.stop = part_start[part], part_end[part]
        self.doc = np.searchsorted(offsets, starts, side="right")[which] - 1
        self.doc_first = np.searchsorted(self.doc, np.arange(len(raw) + 1))
        self.place = np.arange(len(part)) - self.doc_first[self.doc]

    def stream(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Independent draws for all occurrences: arcs in text order, and where each occurrence begins."""
        live = np.arange(len(self.begin))
        node, seed = self.begin, _uniform_seed(self.seeds[self.doc], self.place, k)
        steps = np.zeros(len(live), dtype=np.int64)
        drawn = []
        s = 0
        while len(live):
            arcs = self.lattices.draw(node, _uniform(seed, s))
            drawn.append((live, arcs))
            steps[live] += 1
            node = self.lattices.end[arcs]
            more = node < self.stop[live]
            live, node, seed = live[more], node[more], seed[more]
            s += 1
        offsets = np.concatenate([[0], np.cumsum(steps)])
        flat = np.empty(offsets[-1], dtype=np.int64)
        for s, (live, arcs) in enumerate(drawn):
            flat[offsets[live] + s] = arcs
        return flat, offsets

    def top(self, k: int) -> Iterator[tuple[list[Path], float]]:
        """For each text its k best perturbed paths and the threshold."""
        self.streams = [self.stream(j) for j in range(k)]
        flat, offsets = self.streams[0]
        n = len(self.seeds)
        self.text_steps = steps = offsets[self.doc_first]
        logs = self.lattices.log_p[flat]
        total = np.concatenate([[0.0], np.cumsum(logs)])
        roots = _gumbel(_uniform(self.seeds, 11))
        row = np.repeat(np.arange(n), np.diff(steps))
        prefix = total[:-1] - total[steps[row]]
        # Steps so unlikely to be reached that no double is large enough to matter are left alone.
        near = np.flatnonzero(prefix > -60)
        mass = prefix[near] + _log_rest(logs[near])
        highest = np.full(n, -np.inf)
        np.maximum.at(highest, row[near], mass)
        unsure = np.flatnonzero(highest < SPREAD - 60)
        if len(unsure):
            more = np.flatnonzero((prefix <= -60) & np.isin(row, unsure))
            rest = prefix[more] + _log_rest(logs[more])
            np.maximum.at(highest, row[more], rest)
            near, mass = np.concatenate([near, more]), np.concatenate([mass, rest])
        keep = (mass > highest[row[near]] - SPREAD) & (mass > -np.inf)
        near, mass = near[keep], mass[keep]
        step = near - steps[row[near]]
        value = _below(roots[row[near]], mass, _uniform(self.seeds[row[near]], 12, 0, step))
        order = np.lexsort((-value, row[near]))
        sorted_rows = row[near][order]
        bounds = np.searchsorted(sorted_rows, np.arange(n + 1)).tolist()
        value, step = value[order].tolist(), step[order].tolist()
        roots, cuts = roots.tolist(), steps.tolist()
        for i in range(n):
            first = Path(flat[cuts[i] : cuts[i + 1]], roots[i], float(total[cuts[i + 1]] - total[cuts[i]]), 0)
            lo, hi = bounds[i], min(bounds[i + 1], bounds[i] + k + 1)
            # [value, path, step, arcs already taken there]; of the first path's no more than k can be opened.
            yield self._search(i, k, first, [[value[x], 0, step[x], [int(first.arcs[step[x]])]] for x in range(lo, hi)])

    def _occurrence(self, path: Path, i: int, t: int) -> int:
        """The occurrence in which step t of a path of text i lies."""
        while path.parent is not None and t < path.split:
            path = path.parent
        if path.parent is None:
            return int(np.searchsorted(self.streams[0][1], self.text_steps[i] + t, side="right")) - 1
        if t < path.split + path.own:
            return path.at
        offsets = self.streams[path.stream][1]
        return int(np.searchsorted(offsets, offsets[path.at + 1] + t - path.split - path.own, side="right")) - 1

    def _search(self, i: int, k: int, first: Path, nodes: list[list]) -> tuple[list[Path], float]:
        lattices, logs, seed = self.lattices, self.lattices.log_p, self.seeds[i : i + 1]
        paths, last = [first], int(self.doc_first[i + 1])
        while len(paths) < k and nodes:
            best = max(range(len(nodes)), key=lambda x: nodes[x][0])
            value, j, t, taken = nodes[best]
            old, new = paths[j], len(paths)
            flat, offsets = self.streams[new]
            start = int(lattices.start[old.arcs[t]])
            a, b = int(lattices.first[start]), int(lattices.first[start + 1])
            others = [x for x in range(a, b) if x not in taken]
            chance = np.cumsum(np.exp(logs[others]))
            draws = _uniform(seed, 13, new, np.arange(3))
            pick = others[min(int(np.searchsorted(chance, draws[0] * chance[-1])), len(others) - 1)]
            at, own = self._occurrence(old, i, t), [pick]
            while (node := int(lattices.end[own[-1]])) < self.stop[at]:
                own.append(int(lattices.draw(np.array([node]), _uniform(seed, 14, new, len(own)))[0]))
            arcs = np.concatenate([old.arcs[:t], own, flat[offsets[at + 1] : offsets[last]]])
            own_logs = logs[arcs]
            before = float(own_logs[:t].sum())
            path = Path(arcs, value, float(own_logs.sum()), new, old, t, at, len(own))
            paths.append(path)
            # What is still left out at this step, below the value just found.
            taken = [*taken, pick]
            rest = [x for x in others if x != pick]
            if rest:
                mass = before + float(np.log(np.exp(logs[rest]).sum()))
                nodes[best] = [float(_below(value, mass, draws[1])), j, t, taken]
            else:
                nodes.pop(best)
            nodes += self._beside(path, len(paths) - 1, seed, before + float(own_logs[t]), own_logs, t + 1, k)
        return paths, max((x[0] for x in nodes), default=-np.inf)

    def _beside(self, path: Path, j: int, seed: np.ndarray, before: float, logs: np.ndarray, since: int, k: int) -> list[list]:
        """Nodes beside a path from a step on: the best k + 1, as no more can be opened."""
        masses, highest, at = [], -np.inf, since
        while at < len(logs) and before > highest - SPREAD:
            own = logs[at : at + 256]
            ahead = before + np.cumsum(own)
            masses.append(ahead - own + _log_rest(own))
            highest, before, at = max(highest, float(masses[-1].max())), float(ahead[-1]), at + 256
        if not masses:
            return []
        mass = np.concatenate(masses)
        keep = np.flatnonzero((mass > highest - SPREAD) & (mass > -np.inf))
        if not len(keep):
            return []
        values = _below(path.value, mass[keep], _uniform(seed, 12, j, keep + since))
        order = np.argsort(-values)[: k + 1]
        return [[float(values[x]), j, int(keep[x]) + since, [int(path.arcs[keep[x] + since])]] for x in order]

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        """Piece ids of a path; a code point that is no piece gives an id for each byte."""
        piece = self.lattices.piece[arcs]
        spelled = piece < 0
        if not spelled.any():
            return piece.astype(np.int32)
        n = np.where(spelled, self.lattices.end[arcs] - self.lattices.start[arcs], 1)
        owner, number = _spread(n)
        byte = self.lattices.data[self.lattices.start[arcs][owner] + number]
        return np.where(spelled[owner], self.voc.byte_id[byte], piece[owner]).astype(np.int32)


def _uniform_seed(seed: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    return mix64(seed ^ mix64(place.astype(U64), 17 + k), 18)


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log probability that a path's perturbed value exceeds the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = log_p - threshold
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0))))) if x > -30 else x


def _encode(path: str, k: int, emit: Callable[[Vocabulary, bytes, np.ndarray], dict], schema: pa.Schema):
    """Rows (key, seed, text, ...) to k rows with the samples."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            seeds = mix64(batch.column(1).to_numpy().view(U64), 5)
            for piece in slices(batch.column(2), SLICE):
                raw = [piece.raw(i) for i in range(piece.rows)]
                sampler = Sampler(voc, raw, seeds[piece.first : piece.first + piece.rows])
                row, out = [], {f.name: [] for f in list(schema)[1:]}
                for i, (paths, threshold) in enumerate(sampler.top(k)):
                    for n, p in enumerate(paths):
                        ids = sampler.ids(p.arcs)
                        made = {"sample": n, "n_tokens": len(ids), "log_p": p.log_p, "log_inclusion": log_inclusion(p.log_p, threshold), **emit(voc, raw[i], ids)}
                        row.append(i)
                        for name, values in out.items():
                            values.append(made[name])
                own = batch.column(0).slice(piece.first, piece.rows).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(v, schema.field(n).type) for n, v in out.items())], schema=pa.schema([pa.field(schema[0].name, own.type), *list(schema)[1:]]))

    return run


_COMMON = [("sample", pa.int32()), ("n_tokens", pa.int64()), ("log_p", pa.float64()), ("log_inclusion", pa.float64())]
_COMMON_DDL = "sample int, n_tokens long, log_p double, log_inclusion double"


def _rows(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    return docs.select(column(row).alias("_key"), F.xxhash64(column(id_col)).alias("_seed"), F.coalesce(column(text_col), F.lit("")).alias("_text"))


def encode_samples(docs: DataFrame, samples: int = SAMPLES, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, sample, n_tokens, log_p, log_inclusion, ids): up to `samples` rows for each row of `docs`.

    The ids of different samples of a text spell it by different arcs.
    `log_inclusion` is the log probability that the sample exceeds the
    threshold, the perturbed value of the next one; it is 0 if there is none.
    Draws are seeded by the id, so equal rows have equal samples.

    A null or empty text has one segmentation, without pieces.  A text with
    fewer segmentations than `samples` gives them all.  The character U+2581
    stands for a space in the model and comes back as one.  A null id keeps its
    row.  Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("_key", pa.null()), *_COMMON, ("ids", pa.list_(pa.int32()))])
    run = _encode(model or default_model(), samples, lambda voc, raw, ids: {"ids": ids}, schema)
    return _rows(docs, id_col, text_col, id_col).mapInArrow(run, f"_key {kind}, {_COMMON_DDL}, ids array<int>").withColumnRenamed("_key", id_col)


def decode_ids(encoded: DataFrame, model: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`encoded` with the text that each row's ids spell; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def spell(ids):
        voc = vocabulary(path)
        return ids.map(lambda x: None if x is None else voc.decode(np.asarray(x, dtype=np.int64)).decode("utf-8", "replace"))

    return encoded.withColumn(text_col, spell(F.col(ids_col)))


def _digest(voc: Vocabulary, raw: bytes, ids: np.ndarray) -> dict:
    return {"ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "round_trip": voc.decode(ids) == raw.replace(_MARK.encode(), b" ")}


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the samples of every whole document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("_key", pa.null()), *_COMMON, ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])
    run = _encode(default_model(), SAMPLES, _digest, schema)
    return _rows(docs, "doc_id", "text", "doc_id").mapInArrow(run, f"_key {kind}, {_COMMON_DDL}, ids_sha256 string, round_trip boolean").withColumnRenamed("_key", "doc_id")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
