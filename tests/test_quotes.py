"""Quotes, spans and located claims: one case for each rule, and brute force for mapped offsets."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spark_filings.functions.normal import PATTERN_SCRIPT
from spark_filings.functions.passages import Document, passages_at, passages_of
from spark_filings.operators import quotes
from spark_filings.plans import retrieval

TEXT = "第一节 概况\n本次发行募集资金总额不超过人民币 360,000.00 万元（含本数）。公司计提存货跌价准备 879.50\n万元！！其后说明；\n\n  尾注\n"


def document(text=TEXT):
    return Document(text, PATTERN_SCRIPT)


def test_passages_are_slices(spark):
    got = passages_of(TEXT)
    assert [p[0] for p in got] == ["第一节 概况", "本次发行募集资金总额不超过人民币 360,000.00 万元（含本数）。", "公司计提存货跌价准备 879.50", "万元！！", "其后说明；", "尾注"]
    assert all(TEXT[s:e] == p for p, s, e in got)
    assert passages_of("") == passages_of(" \n。"[:2]) == [] and passages_of("a\n。b") == [("a\n。", 0, 3), ("b", 3, 4)]
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string").select("id", passages_at(F.col("text")).alias("p")).collect()
    assert {r.id: [tuple(p) for p in r.p] for r in rows} == {1: got, 2: [], 3: []}


def test_locate():
    d = document()
    assert d.locate(" 存货跌价准备 879.50 ") == (TEXT.index("存货"), TEXT.index("879.50") + 6, True)
    start, end, exact = d.locate("計提存貨".replace("計", "计").replace("貨", "货") + "跌價準備".replace("準備", "准备") + "879.50万元")
    assert not exact and TEXT[start:end] == "计提存货跌价准备 879.50\n万元"
    start, end, exact = d.locate("募集資金總額")
    assert not exact and TEXT[start:end] == "募集资金总额"
    assert d.locate("存货跌价准备 999.99") is d.locate("  ") is d.locate("存货，跌价") is None


@pytest.mark.parametrize("seed", range(3))
def test_mapped_offsets(seed):
    """A quote with other white space is where a pattern that allows any white space finds it first."""
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice("ab \n　​萬万") for _ in range(rng.randrange(40)))
        quote = "".join(rng.choice("ab 万萬") for _ in range(rng.randrange(1, 6)))
        got = document(text).locate(quote)
        bare = [c for c in quote if not c.isspace()]
        if not bare:
            assert got is None
            continue
        anyhow = re.search(r"[\s​]*".join("[万萬]" if c in "万萬" else c for c in bare), text)
        assert (got is None) == (anyhow is None)
        if got:
            start, end, exact = got
            assert exact == (quote.strip() in text)
            assert exact or (start, end) == anyhow.span() or len(text[start:end]) == len(quote.strip())


def chosen(text, quote, claim):
    got = document(text).choose(quote, claim)
    assert text[got["start"] : got["end"]] == got["span"]
    return got


def test_spans_are_whole_sentences():
    claim = "募集资金总额不超过人民币 360,000.00 万元。"
    whole = "本次发行募集资金总额不超过人民币 360,000.00 万元（含本数）。"
    for part in ("募集资金总额不超过人民币", "360,000.00 万元（含本数）", "募集資金總額"):
        got = chosen(TEXT, part, claim)
        assert got["span"] == whole and got["adjusted"]
    got = chosen(TEXT, whole, claim)
    assert not got["adjusted"] and got["path"] == f"occurrences=1 figures=1/1 overlap=1.00 chars={len(whole)} sentence-aligned"


def test_spans_reach_figures_and_open_lines():
    text = "公司拟发行股票。\n数量不超过总股本的 30%。\n此前为 20%。"
    assert chosen(text, "拟发行股票", "不超过 30%")["span"] == "公司拟发行股票。\n数量不超过总股本的 30%。"
    got = chosen(text, "此前为", "30% 与 20%")
    assert got["span"] == "数量不超过总股本的 30%。\n此前为 20%。" and "extended-to-figure" in got["path"]
    table = "项目名称\n期末余额\n\n1,234.56"
    got = chosen(table, "项目名称", "期末余额已披露。")
    assert got["span"] == table and got["path"].endswith("extended-open-boundary")
    assert chosen("期末余额。\n1,234.56", "期末余额。", "已披露。")["span"] == "期末余额。"
    far = "\n".join(f"第{k}段说明文字，本段不含任何数字信息。" for k in "一二三四五六七八九十甲乙") + "\n实际发行 12,345,678 股。"
    assert "12,345,678" not in chosen(far, "第一段", "发行 12,345,678 股。")["span"]
    assert len(chosen("甲\n" * 300, "甲\n甲", "x")["span"]) <= 240


def test_the_best_of_several_places():
    text = "本次交易的对价支付安排如下所述。\n交易对价合计 11,400 万元。\n本次交易的对价支付安排另行约定。"
    got = chosen(text, "本次交易的对价支付安排", "交易对价合计 11,400 万元。")
    assert got["span"].startswith("本次交易的对价支付安排如下") and "11,400" in got["span"] and "occurrences=2" in got["path"]
    twice = "公司披露了计提。\n公司披露了计提，并说明了后续安排。\n公司披露了计提。"
    assert chosen(twice, "公司披露了计提", "公司披露了计提。")["start"] == 0
    assert document().choose("不存在", "x") is None


def test_located_rows(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TOGETHER", 2)
    docs = spark.createDataFrame([("d", TEXT), ("e", "aaa"), ("e", "aaa"), ("n", None)], "document_id string, text string")
    asked = [("d", "万元"), ("d", "万元"), ("d", "879.50万元"), ("d", "no"), ("d", None), ("e", "a"), ("n", "a"), ("x", "a"), (None, "a"), ("d", " ")]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, document_id string, quote string")
    got = {r.id: (r.start, r.end, r.located, r.exact) for r in quotes.locate_quotes(rows, docs).collect()}
    at, far = TEXT.index("万元"), TEXT.index("879.50")
    none = (None, None, None, None)
    assert got == {0: (at, at + 2, "万元", True), 1: (at, at + 2, "万元", True), 2: (far, far + 9, "879.50\n万元", False), 5: (0, 1, "a", True), **{k: none for k in (3, 4, 6, 7, 8, 9)}}
    spans = quotes.choose_spans(rows.withColumn("claim", F.when(F.col("id") != 5, "第一节")), docs)
    got = {r.id: (r.span, r.adjusted) for r in spans.collect()}
    assert got[0] == got[1] and got[0][1] and got[5] == ("a", False) and got[3] == (None, None)


def test_located_claims(spark):
    filings = spark.createDataFrame([("r", "a", 0, "甲公司收入 5 元。同一句话。"), ("r", "b", 1, "同一句话。乙公司。同一句话，说得很长很长很长很长很长很长。"), ("r", "n", 2, None), ("q", "c", 0, "只在这里。")], "run string, document_id string, position int, text string")
    proposals = [
        ("r", "named", "x", [("b", "同一句话")]),
        ("r", "other", "x", [("b", "收入 5 元")]),
        ("r", "first", "x", [(None, "同一句话"), ("zz", " "), ("a", "甲公司")]),
        ("r", "lost", "x", [("a", "甲公司"), ("a", "没有" * 30), ("a", "也没有")]),
        ("r", "other run", "x", [("c", "只在这里")]),
        ("r", "blank", None, [("a", "  ")]),
        ("r", "none", "x", []),
        ("r", "null", "x", None),
        ("q", "named", None, [("c", "只在")]),
        ("r", "long", "x", [(None, "同一句話，说得 很长很长很长很长很长很長")]),
    ]
    rows = spark.createDataFrame(proposals, "run string, claim_id string, text string, quotes array<struct<document_id:string,quote:string>>")
    evidence, verdicts = quotes.locate_claims(rows, filings)
    lost = "quote is not present in any retrieved document: 「{}」"
    assert {(r.run, r.claim_id): r.reason for r in verdicts.collect()} == {
        **{("r", k): None for k in ("named", "other", "first", "long")},
        ("q", "named"): None,
        ("r", "lost"): lost.format("没有" * 20),
        ("r", "other run"): lost.format("只在这里"),
        **{("r", k): "claim carries no usable quote" for k in ("blank", "none", "null")},
    }
    assert sorted((r.run, r.claim_id, r.place, r.document_id, r.quote) for r in evidence.collect()) == [
        ("q", "named", 0, "c", "只在这里。"),
        ("r", "first", 0, "a", "同一句话。"),
        ("r", "first", 2, "a", "甲公司收入 5 元。"),
        ("r", "long", 0, "b", "同一句话，说得很长很长很长很长很长很长。"),
        ("r", "named", 0, "b", "同一句话。"),
        ("r", "other", 0, "a", "甲公司收入 5 元。"),
    ]


def test_only_wanted_grams_leave_the_helper(spark):
    rows = spark.createDataFrame([("r", "a", "the quick brown fox jumps over it"), ("r", "b", "a quick  brown fox jumps as well"), ("r", "c", "nothing of the kind is said here"), ("r", "d", None)], "run string, document_id string, text string")
    every = {tuple(r) for r in quotes._grams(rows, "document_id", F.col("text"), PATTERN_SCRIPT).collect()}
    wanted = {g for _, key, g in every if key == "a"}
    got = quotes._grams(rows, "document_id", F.col("text"), PATTERN_SCRIPT, np.array(sorted(wanted))).collect()
    assert {tuple(r) for r in got} == {r for r in every if r[2] in wanted} and {r.key for r in got} == {"a", "b"}
    assert not quotes._grams(rows, "document_id", F.col("text"), PATTERN_SCRIPT, np.zeros(0, dtype=np.int64)).collect()


def test_only_the_nearest_leave_a_task():
    index = SimpleNamespace(value=retrieval.UnitIndex(pa.table({"unit": ["a", "b", "c"], "item": [0, 0, 0]})))
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4, 5], "n_chars": [9, 5, 9, 8, 8], "units": [["a", "b"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["c", "b", "a"]]})
    left = [r for b in retrieval._meet(index, ["doc_id"], 2, "n_chars")([batch, batch.slice(0, 2)]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n_shared"]) for r in left] == [(4, 3), (5, 3)]
