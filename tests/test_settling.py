"""Claims that state what is asked, and units that claims translate: one case for each rule."""

import random

import pytest

from spark_filings.operators import recipes, settling


def test_settled_claims(spark):
    questions = [("r", "Q1", "募集資金金額是多少"), ("r", "Q2", "募集资金还可使用多少金额"), ("r", "Q3", "发行价格"), ("r", "Q4", "多少股"), ("r", "Q5", "why"), ("r", "Q6", "金额上限是多少"), ("r", "Q7", "何时"), ("r", "Q8", "占比"), ("r", "Q9", "案號是什麼")]
    claims = [
        ("a", "Q1", "共 5 万元", None, True),
        ("b", "Q1", "共 5 项", None, False),
        ("c", "Q1", "不超过 5 万元", None, False),
        ("d", "Q6", "不超过 5 万元", None, True),
        ("e", "Q1", "共 5 万元", True, False),
        ("f", "Q2", "已使用 5 万元", None, False),
        ("g", "Q2", "已使用 5 万元，剩余 7 万元", None, True),
        ("h", "Q3", "3.62 元/股", None, True),
        ("i", "Q3", "每股 3.62 元", None, True),
        ("j", "Q3", "共 3.62 元", None, False),
        ("k", "Q4", "共 100 股", None, True),
        ("l", "Q4", "共 100 项", None, False),
        ("m", "Q5", "7", None, True),
        ("n", "Q5", "seven", None, False),
        ("o", "Q7", "2026年8月13日", None, True),
        ("p", "Q8", "5%", None, True),
        ("q", "Q9", "（2026）浙02破申13号", None, True),
        ("s", "unknown", "1", None, True),
        ("t", "Q1", None, None, False),
    ]
    rows = spark.createDataFrame([("r", *c[:4]) for c in claims], "run string, claim_id string, question_id string, text string, unverifiable boolean")
    asked = spark.createDataFrame(questions, "run string, question_id string, question string")
    got = {r.claim_id: r.settles for r in settling.settled_claims(rows, asked).collect()}
    assert got == {c[0]: c[4] for c in claims}
    assert settling.settled_claims(rows.where("false"), asked).collect() == []


def test_translated_units(spark):
    claims = spark.createDataFrame([("a", "RMB 7,654,321 and $5"), ("b", "7,654,321 元"), ("c", "7,654,321"), ("d", "CNY 2,468.13 in all"), ("e", "CNY 9"), ("f", None)], "claim_id string, text string")
    evidence = spark.createDataFrame([("a", 1, "共 7,654,321元"), ("a", 0, "5 美元"), ("b", 0, "7,654,321元"), ("c", 0, "7,654,321元"), ("d", 0, "2,468.13万元"), ("e", 0, "CNY 9"), ("f", 0, None)], "claim_id string, position int, quote string")
    got = {r.claim_id: (r.written, r.printed) for r in settling.translated_units(claims, evidence).collect()}
    assert got == {"a": ("RMB 7,654,321", "7,654,321元"), "d": ("CNY 2,468.13", "2,468.13万元")}


@pytest.mark.parametrize("seed", range(2))
def test_questions_merge_in_order(spark, seed):
    """Against the greedy walk, with chains in which who is kept depends on the order."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(9)]
    rows = [(run, f"q{k}", k, " ".join(rng.sample(words[: rng.choice([5, 6, 9])], rng.choice([0, 3, 4, 4, 5])))) for run in ("r", "s") for k in range(60)]
    rows += [("t", "only", 0, None), ("t", "same", 1, "?!"), ("t", "other", 2, "a")]
    want = []
    for run in ("r", "s", "t"):
        kept = []
        for _, q, _, text in [x for x in rows if x[0] == run]:
            own = set((text or "").replace("?!", "").split())

            def same(other):
                return own == other if not own or not other else len(own & other) >= 0.75 * max(len(own), len(other))

            twin = next((k for k, u in kept if same(u)), None)
            if twin is None:
                kept.append((q, own))
            want.append((run, q, twin or q))
    got = recipes.dedupe_questions(spark.createDataFrame(rows, "run string, question_id string, position int, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len({(r, k) for r, _, k in want}) < len(want)
