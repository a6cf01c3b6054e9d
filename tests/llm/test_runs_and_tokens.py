"""Periodic runs and token counts against brute force and the library, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_filings.llm import common, periodic_runs, token_counts

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    rows = [
        (None, "a null id " * 12),
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "one two three " * 9),
        (4, "one two three " * 9),
        (5, "one two three " * 9),
        (6, "long " * 20_000),
        (7, "x" * 30_000 + " é中 \U0001f600 ▁ </s> \x00\x01"),
    ]
    clashes = ["_id string", "_text string", "runs string", "greatest int", "collapsed string", "n_tokens string", "n_bytes string", "`a.b` string"]
    return spark.createDataFrame([(*r, *"abc", 1, *"defg") for r in rows], ", ".join(["doc_id long", "text string", *clashes]))


def brute_runs(words, least=24, periods=3):
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_runs(words):
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def test_op12(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in periodic_runs.op12_periodic_runs(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    assert {k: expected_runs(planted(k, t)) for k, t in texts.items()} == got
    assert sum(r[0] > 0 for r in got.values()) > 5


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_made_texts(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 70]))]
            repeated = unit * rng.randrange(1, 8)
            words += repeated[: rng.randrange(1, len(repeated) + 1)] + [rng.randrange(3) for _ in range(rng.randrange(4))]
        docs.append(np.array(words, dtype=np.int64))
    docs += [np.zeros(n, dtype=np.int64) for n in (0, 23, 24, 100)] + [np.arange(2000) % 600, np.arange(100)]
    found = {}
    for d, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(docs))):
        found.setdefault(d, []).append(tuple(run))
    assert [found.get(i, []) for i in range(len(docs))] == [brute_runs(d.tolist()) for d in docs]


def test_extensions():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 2, 300), np.zeros(200, dtype=np.int64), np.arange(200) % 5, np.zeros(150, dtype=np.int64)])
    i, j = np.sort(rng.integers(0, len(x), (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    want = [next((k for k in range(len(x) - b) if x[a + k] != x[b + k]), len(x) - b) for a, b in zip(i.tolist(), j.tolist())]
    assert periodic_runs.Extensions(x).common(i, j).tolist() == want


def test_greatest_is_exact():
    big = 10**9
    assert periodic_runs.greatest([5, 9], [3 * big, 3 * big + 1], [big, big]) == 1
    assert periodic_runs.greatest([9, 5, 5], [30, 60, 90], [10, 20, 30]) == 1


def test_runs_odd(spark, odd):
    out = periodic_runs.periodic_runs(odd).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((len(r["runs"]), r["greatest"] and tuple(r["greatest"]), r["collapsed"]))
    assert len(out) == odd.count()
    assert by[None] == [(1, (0, 36, 3), "a null id")]
    assert by[1] == by[2] == by[3] == [(0, None, "")]
    assert by[4] == by[5] * 2 == [(1, (0, 27, 3), "one two three")] * 2
    assert by[6] == [(1, (0, 20_000, 1), "long")]
    assert periodic_runs.periodic_runs(odd.where("false")).collect() == []
    dotted = odd.withColumnRenamed("doc_id", "id.of")
    assert periodic_runs.periodic_runs(dotted, "id.of").count() == len(out)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_op13(spark, texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.op13_token_counts(spark, DATA).collect()}
    want = {}
    for k, t in texts.items():
        n = len(library.encode(t or ""))
        want[k] = (len((t or "").encode()), n, n > 4096)
    assert got == want


def test_tokens_of_made_texts(library):
    model, rng = token_counts.merges(token_counts.default_model()), random.Random(3)
    alphabet = "abthe ine  ▁\n\té中文字\U0001f600<s></s>0x41=--\x00\x01"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    made += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(300))) for _ in range(500)]
    made += ["", None, " ", "  ", "▁", "<s>", "<0x41>", "the" * 100, "a" * 1000, "=" * 999, " " * 500, "thethe " * 50, "�", " x"]
    import pyarrow as pa

    got = [n for part in common.slices(pa.array(made), 10_000) for n in token_counts.token_counts(model, part).tolist()]
    assert got == [len(library.encode(t or "")) for t in made]


def test_long_sequences_in_rounds_and_queue():
    model, rng = token_counts.merges(token_counts.default_model()), random.Random(4)
    for unit in ("the", "a", "=", "ab", "ing"):
        text = "".join(rng.choice([unit, unit, rng.choice("etaoin")]) for _ in range(60))
        symbols = model.code[[ord(c) for c in text]]
        assert token_counts.surviving(model, symbols[None, :])[0] == token_counts.surviving_long(model, symbols)


def test_tokens_odd(spark, odd, library):
    rows = {(r["doc_id"], r["text"]): len(library.encode(r["text"] or "")) for r in odd.collect()}
    out = token_counts.count_tokens(odd, limit=100).collect()
    assert len(out) == odd.count()
    assert sorted((r["n_tokens"], r["over_limit"]) for r in out) == sorted((n, n > 100) for n in [*rows.values(), rows[4, "one two three " * 9]])
    assert token_counts.count_tokens(odd.where("false")).collect() == []
    assert token_counts.count_tokens(odd.withColumnRenamed("doc_id", "id.of"), "id.of").columns == ["id.of", "n_bytes", "n_tokens", "over_limit"]


def test_distinct_spans_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(common, "hash_spans", lambda data, s, e: np.zeros(len(s), dtype=np.uint64))
    data = np.frombuffer(b"aabbaa" + b"x" * 20 + b"x" * 19 + b"y", dtype=np.uint8)
    starts, ends = np.array([0, 2, 4, 6, 26]), np.array([2, 4, 6, 26, 46])
    same, one = common.distinct_spans(data, starts, ends)
    assert same.tolist() == [0, 1, 0, 2, 3] and one.tolist() == [0, 1, 3, 4]


def test_best_stretches_are_those_of_all_pairs():
    """The tree's best stretch of any part is the best of all pairs: it ends first, then begins first."""
    from spark_filings.llm import secrets

    rng = np.random.default_rng(6)
    least = secrets.LEAST_TOKEN
    for _ in range(150):
        n = int(rng.integers(least, 90))
        total = np.concatenate([[0.0], np.cumsum(rng.choice([-1.0, -0.5, 0, 0.5, 1, 2], n))])
        best = secrets._Best(total)
        for _ in range(10):
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            if hi - lo >= least:
                want = min((total[a + 1] - total[b], b, a) for a in range(lo, hi - least + 1) for b in range(a + least, hi + 1))
                assert best.of(lo, hi) == (-want[0], want[2], want[1])


def test_stretches_take_time_in_proportion():
    import time

    from spark_filings.llm import secrets

    rng, took = np.random.default_rng(7), []
    for n in (100_000, 400_000):
        unit = np.concatenate([rng.normal(-3, 0.3, 20), rng.normal(2, 0.3, 20)])
        total, separates = np.concatenate([[0.0], np.cumsum(np.tile(unit, n // 40))]), np.arange(n) % 40 == 0
        began = time.process_time()
        assert len(secrets._stretches(total, separates)) == n // 40
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize("name", ["fingerprint", "minhash", "mixing", "line_dedup", "quality_rules", "lm_score", "sentencepiece", "suffix_dedup", "secrets", "url_filter"])
def test_ids_whose_name_has_a_dot(spark, name):
    from spark_filings.llm import fingerprint, line_dedup, lm_score, minhash, mixing, quality_rules, secrets, sentencepiece, suffix_dedup, url_filter

    docs = spark.createDataFrame([(k, f"some words of text number {k} " * 12, "s") for k in range(6)], "`id.of` long, text string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "`id.of` long, quality int")
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "`id.of` long, url string")
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, verdict string")
    out = {
        "fingerprint": lambda: fingerprint.fingerprint_neighbours(docs, "id.of"),
        "minhash": lambda: minhash.near_duplicates(docs, id_col="id.of"),
        "mixing": lambda: mixing.mix_rows(docs, id_col="id.of"),
        "line_dedup": lambda: line_dedup.dedup_lines(docs, "id.of"),
        "quality_rules": lambda: quality_rules.keep_good(docs, labels, "id.of"),
        "lm_score": lambda: lm_score.score_texts(docs, F.lit(False), id_col="id.of"),
        "sentencepiece": lambda: sentencepiece.encode_samples(docs, id_col="id.of"),
        "suffix_dedup": lambda: suffix_dedup.remove_repeats(docs, id_col="id.of"),
        "secrets": lambda: secrets.scan_secrets(docs, id_col="id.of"),
        "url_filter": lambda: url_filter.filter_urls(pages, rules, id_col="id.of"),
    }[name]()
    assert "id.of" in out.columns and out.count() >= 0
