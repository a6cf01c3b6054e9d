"""Phrase collocations against brute force and SQL, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from spark_filings.llm import collocations

DATA = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=30, top=2000, within=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(4, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * longest[p] >= within * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_op11(spark):
    rows = duckdb.sql(f"select lang, text from '{DATA}/documents.parquet'").fetchall()
    got = rows_of(collocations.op11_collocations(spark, DATA))
    assert got == brute(rows) and len(got) > 20
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert got == sorted(con.sql(collocations.ORACLES["op11_collocations"]).fetchall())


@pytest.mark.parametrize("budget", [3, 40])
def test_made_texts_in_many_groups(spark, budget):
    """Small budgets extend prefixes to whole suffixes; control characters sort between words and their ends."""
    rng = random.Random(budget)
    vocabulary = ["a", "a\x01", "a\x0e", "b", "É", "é", "中", "The", "x" * 300]
    rows = []
    for k in range(300):
        words = [rng.choice(vocabulary[: rng.choice([2, 4, 9])]) + rng.choice(["", "", "", " ", "\t", ".", ",", "\n", "\x0b"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "de", None, "l g"]), " ".join(words)))
    docs = spark.createDataFrame([(*r, "z") for r in rows], "lang string, text string, phrase string").repartition(5)
    got = rows_of(collocations.collocations(docs, least=3, budget=budget, top=50))
    assert got == brute(rows, least=3, top=50) and len(got) > 60


def test_repeated_rows_hot_phrase_and_odd_texts(spark):
    rows = [("en", "one two three four five")] * 500 + [("en", None), (None, ""), ("fr", " \n"), (None, "one two. " * 40), ("de", "long " * 5000 + "w" * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").repartition(7)
    assert rows_of(collocations.collocations(docs, budget=30)) == brute(rows)


def test_empty_table_and_dotted_columns(spark):
    docs = spark.createDataFrame([("en", "a b " * 40)], "`l.g` string, `t.x` string")
    assert collocations.collocations(docs.where("false"), "l.g", "t.x").collect() == []
    assert rows_of(collocations.collocations(docs, "l.g", "t.x")) == brute([("en", "a b " * 40)])


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**18
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)], "lang string, phrase string, f long")
    (row,) = collocations.scored(counts, 30).collect()
    assert row["score"] == 2000000 * (big - 2) // (2 * big - 1)
