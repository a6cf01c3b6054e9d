"""The verifier's figures, bindings, sweeps and derivations: one case for each rule."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spark_filings.functions.figures import figures, figures_of, unit_hints, unit_hints_of
from spark_filings.operators import binding, derivations
from spark_filings.operators.matching import exploded
from spark_filings.plans import verifying

ROWS = "claim_id string, text string"


def kinds(text):
    return [(f["raw"], f["kind"], f["value"], f["unit"]) for f in figures_of(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("公司于2026年8月13日收到（2026）浙02破申13号，确认货款1,500,000元。", [("2026年8月13日", "date", "2026-08-13", "date"), ("（2026）浙02破申13号", "doc_no", "(2026)浙02破申13号", "doc_no"), ("1,500,000元", "amount", "1500000", "CNY")]),
        ("on August 13, 2026 and 6 May 2026", [("August 13, 2026", "date", "2026-08-13", "date"), ("6 May 2026", "date", "2026-05-06", "date")]),
        ("May the company complete it. 45 May 2026", [("45", "scalar", "45", "scalar"), ("2026", "scalar", "2026", "scalar")]),
        ("7,199.78 万元 1.5亿元 百万", [("7,199.78 万元", "amount", "71997800", "CNY"), ("1.5亿元", "amount", "150000000", "CNY")]),
        ("占比 119.46%，为上期的 2.3 倍，计提 -10.84", [("119.46%", "percent", "119.46", "percent"), ("2.3 倍", "multiple", "2.3", "multiple"), ("-10.84", "scalar", "-10.84", "scalar")]),
        ("３６１度 １，５００ 万元 ９５．５％", [("３６１", "scalar", "361", "scalar"), ("１，５００ 万元", "amount", "15000000", "CNY"), ("９５．５％", "percent", "95.5", "percent")]),
        ("3.62 元/股, HK$3.14 million", [("3.62 元/股", "amount", "3.62", "CNY/unit"), ("HK$3.14 million", "amount", "3140000", "HKD")]),
        ("RMB 42 billion; $7; ¥ 8 thousand", [("RMB 42 billion", "amount", "42000000000", "CNY"), ("$7", "amount", "7", "USD"), ("¥ 8 thousand", "amount", "8000", "CNY")]),
        ("is 7,654,321. v1.2.3", [("7,654,321", "scalar", "7654321", "scalar")]),
        ("募集資金 5 萬元，7 us dollars", [("5 萬元", "amount", "50000", "CNY"), ("7 us dollars", "amount", "7", "USD")]),
        ("5,2024-01-02", [("2024-01-02", "date", "2024-01-02", "date")]),
        ("-0.50 and 007.10 " + "9" * 60 + "万元", [("-0.50", "scalar", "-0.5", "scalar"), ("007.10", "scalar", "7.1", "scalar"), ("9" * 60 + "万元", "amount", "9" * 60 + "0000", "CNY")]),
    ],
)
def test_figures(text, expected):
    assert kinds(text) == expected
    for f in figures_of(text):
        assert text[f["start"] : f["end"]] == f["raw"]


def test_figures_of_rows(spark):
    rows = spark.createDataFrame([(1, "3 and 4元"), (2, None), (3, ""), (4, "none"), (5, "\U0001f600５")], "id int, text string")
    got = {r[0]: [(f.raw, f.start, f.end) for f in r[1]] for r in rows.select("id", figures(F.col("text"))).collect()}
    assert got == {1: [("3", 0, 1), ("4元", 6, 8)], 2: [], 3: [], 4: [], 5: [("５", 1, 2)]}


def declared(text):
    return [(h["unit"], h["multiplier"], h["figures"]) for h in unit_hints_of(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("单位：人民币万元\n资产减值损失 7,199.78", [("CNY", "10000", None)]),
        ("單位：人民幣萬元 单位:万元 单位：美元", [("CNY", "10000", None), ("USD", "1", None)]),
        ("(in millions of dollars), in thousands of RMB, in billions", [("USD", "1000000", None), ("CNY", "1000", None), ("USD", "1000000000", None)]),
        ("增減（%）\n净利润 107,086 102,589 4.38 4.38", [("percent", "1", ["107086", "102589", "4.38"])]),
        ("利率（%）\n第一期 2.25\n反映发行人偿债能力的指标：\n倍数 3.85", [("percent", "1", ["2.25"])]),
        ("率(%) 1 比例( % ) 2 单位：元 3", [("CNY", "1", None), ("percent", "1", ["1"]), ("percent", "1", ["2"])]),
        ("率(%) 1 第二节 2", [("percent", "1", ["1"])]),
        ("率(%) 1\n2.1 概况 7", [("percent", "1", ["1"])]),
        ("率(%) 1 " + "x" * 1600 + " 2", [("percent", "1", ["1"])]),
        ("no unit, minimum", []),
    ],
)
def test_unit_hints(text, expected):
    assert declared(text) == expected


def test_unit_hints_of_rows(spark):
    rows = spark.createDataFrame([(1, "率(%) 1"), (2, None), (3, "x")], "id int, text string")
    got = {r[0]: [(h.unit, h.start, h.end, h.figures) for h in r[1]] for r in rows.select("id", unit_hints(F.col("text"))).collect()}
    assert got == {1: [("percent", 1, 6, ["1"])], 2: [], 3: []}


def swept(spark, text, sources, allowed=()):
    texts = spark.createDataFrame([("r", "t", text)], "run string, text_id string, text string")
    docs = spark.createDataFrame([("r", str(i), s) for i, s in enumerate(sources)], "run string, document_id string, text string")
    more = spark.createDataFrame([("r", d) for d in allowed], "run string, display string") if allowed else None
    return [(r.raw, r.verdict, r.severity, r.nearest) for r in binding.verify_numbers(texts, docs, more).orderBy("place").collect()]


def test_sweep(spark):
    source = "虚增营业收入 4435.88 万元，占当期营业收入 5.96%。"
    good = ("verified", None, None)
    assert swept(spark, "4435.88 万元", [source]) == [("4435.88 万元", *good)]
    assert swept(spark, "4435.88 元", [source]) == [("4435.88 元", "unit_mismatch", "high", "4435.88 万元")]
    assert swept(spark, "9999.99 万元 2019 年", [source]) == [("9999.99 万元", "not_in_source", "high", None), ("2019", "unsupported_year", "low", None)]
    assert swept(spark, "44358800 元 4435.88", [source]) == [("44358800 元", *good), ("4435.88", *good)]
    assert swept(spark, "44358800 美元", [source]) == [("44358800 美元", "unit_mismatch", "high", "4435.88 万元")]
    header, bare = "单位：人民币万元\n资产减值损失 7,199.78", "本次涉及金额 100 项"
    assert [v[1] for v in swept(spark, "100 万元 7,199.78 万元 7,199.78 亿元", [bare, header])] == ["not_in_source", "verified", "not_in_source"]
    table = "本期比上年同期增減(%)\n净利润 4.38"
    assert [v[1] for v in swept(spark, "4.38% 4.39%", [table])] == ["verified", "not_in_source"]
    assert [v[1] for v in swept(spark, "4.38%", ["净利润 4.38"])] == ["not_in_source"]
    assert [v[1] for v in swept(spark, "1.82 元/股 1.82 元", ["x"], ["1.82 元/股"])] == ["verified", "unit_mismatch"]
    assert [v[1] for v in swept(spark, "August 13, 2026 （2026）浙02破申13号", ["2026年8月13日 (2026)浙02破申 13号"])] == ["verified", "verified"]


def test_sweep_of_texts(spark):
    texts = spark.createDataFrame([("r", "a", "5元 1999"), ("r", "b", "6元 7元"), ("q", "a", "5元"), ("q", "n", None)], "run string, text_id string, text string")
    sources = spark.createDataFrame([("r", "d", "5元 6元"), ("r", "d", "5元 6元"), ("q", "d", None)], "run string, document_id string, text string")
    got = {(r.run, r.text_id): (r.n_figures, r.n_high, r.n_low, r.ok) for r in binding.sweep(binding.verify_numbers(texts, sources)).collect()}
    assert got == {("r", "a"): (2, 0, 1, True), ("r", "b"): (2, 1, 0, False), ("q", "a"): (1, 1, 0, False)}
    assert binding.verify_numbers(texts.where("false"), sources).collect() == []


def test_bind(spark):
    claims = spark.createDataFrame([("a", "合计 1.82 元/股，计提 7,199.78 万元，占 4.38%，于 2019 年，共 24。9 元"), ("b", "7,199.78 万元"), ("n", None)], ROWS)
    hint = [("CNY", "10000", "单位：万元", None, None, None), ("percent", "1", "（%）", 0, 9, ["4.38"])]
    evidence = spark.createDataFrame(
        [("a", "E2", 1, "计提 7,199.78 和 4.38", hint), ("a", "E1", 0, "计提 7,199.78 24 元", []), ("a", "E3", 2, None, None)],
        "claim_id string, evidence_id string, position int, quote string, hints array<struct<unit:string,multiplier:string,source:string,start:int,end:int,figures:array<string>>>",
    )
    derived = spark.createDataFrame([("a", "D-A", 0, "1.82 元/股")], "claim_id string, derived_id string, position int, display string")
    got = [(r.claim_id, r.raw, r.provenance, r.source_id, r.unit_from, r.state) for r in binding.bind_numbers(claims, evidence, derived).orderBy("claim_id", "place").collect()]
    assert got == [
        ("a", "1.82 元/股", "derived", "D-A", None, "bound"),
        ("a", "7,199.78 万元", "verbatim", "E2", "单位：万元", "bound"),
        ("a", "4.38%", "verbatim", "E2", "（%）", "bound"),
        ("a", "2019", None, None, None, "weak"),
        ("a", "24", "verbatim", "E1", None, "bound"),
        ("a", "9 元", None, None, None, "unbound"),
        ("b", "7,199.78 万元", None, None, None, "unbound"),
    ]
    assert binding.bind_numbers(claims, evidence.where("false")).where("state = 'bound'").count() == 0


EVIDENCE = [
    ("E1", "d", "计提资产减值损失 7,199.78 存货跌价准备"),
    ("E2", "d", "合计 8,815.45 万元"),
    ("E3", "s", "成交总金额为 30,050,162.75 元（不含交易费用）"),
    ("E4", "s", "累计回购公司股份 16,498,650 股"),
    ("E5", "s", "减持均价为 3.62 元/股，占 30%，另 0.00 元，于 2026年8月13日，5 美元"),
]


def derive(spark, proposals, evidence=EVIDENCE):
    """{id: row} of proposals (id, op, operands[, precision]); an operand is (figure, evidence) or the id of another."""
    rows = [("r", p[0], i, p[1], p[3] if len(p) > 3 else None, [(None, None, o) if isinstance(o, str) else (*o, None) for o in p[2]]) for i, p in enumerate(proposals)]
    schema = "run string, proposal_id string, position int, op string, precision int, operands array<struct<display:string,evidence_id:string,derived_id:string>>"
    hints = [("CNY", "10000", "单位：万元", None, None, None)]
    held = spark.createDataFrame([("r", e, i, d, q, hints if d == "d" else None) for i, (e, d, q) in enumerate(evidence)], "run string, evidence_id string, position int, document_id string, quote string, hints array<struct<unit:string,multiplier:string,source:string,start:int,end:int,figures:array<string>>>")
    out = derivations.compute_derivations(spark.createDataFrame(rows, schema), held).collect()
    assert len(out) == len(proposals)
    return {r.proposal_id: r for r in out}


WAN, SUM = ("7,199.78 万元", "E1"), ("8,815.45 万元", "E2")


def test_derivations_of_one_level(spark):
    got = derive(
        spark,
        [
            ("ratio", "ratio", [WAN, SUM]),
            ("sum", "sum", [WAN, SUM]),
            ("less", "difference", [SUM, WAN], 0),
            ("other quote", "ratio", [("7,199.78 万元", "E1"), ("8,815.45 万元", "E1")]),
            ("price", "quotient", [("30,050,162.75", "E3"), ("16,498,650", "E4")]),
            ("part", "product", [("16,498,650", "E4"), ("30%", "E5")], 0),
            ("part of part", "product", [("30%", "E5"), ("30%", "E5")]),
            ("unnamed", "sum", [("3.62 元/股", None), ("3.62 元/股", "E9")]),
        ],
    )
    assert {k: (r.value, r.unit, r.display) for k, r in got.items()} == {
        "ratio": ("0.8167229126", "ratio", "81.67%"),
        "sum": ("160152300", "CNY", "160152300.00"),
        "less": ("16156700", "CNY", "16156700"),
        "other quote": ("0.8167229126", "ratio", "81.67%"),
        "price": ("1.8213710061", "CNY/unit", "1.82 元/股"),
        "part": ("4949595", "scalar", "4949595"),
        "part of part": ("0.09", "ratio", "9.00%"),
        "unnamed": ("7.24", "CNY/unit", "7.24 元/股"),
    }
    assert got["ratio"].formula == "7,199.78 万元 / 8,815.45 万元" and got["ratio"].derived_id == "D-A" and got["ratio"].depth == 1
    assert got["other quote"].found_in == ["E1", "E2"]
    # Half a unit of the last place, in 元, added up: 50 + 50.
    assert got["sum"].uncertainty == got["less"].uncertainty == "100"
    assert got["price"].formula == "30,050,162.75 元 / 16,498,650"


def test_intervals(spark):
    evidence = [("E", "d", "1 2 10 20 3")]
    got = derive(spark, [("same", "quotient", [("1", "E"), ("1", "E")]), ("product", "product", [("30%", "P"), ("20", "E")])], [*evidence, ("P", "d", "30%")])
    # 0.5/1.5 to 1.5/0.5: two to one side.
    assert (got["same"].value, got["same"].uncertainty, got["same"].tolerance, got["same"].unit) == ("1", "2", "2", "multiple")
    # 29.5 % of 19.5 to 30.5 % of 20.5.
    assert (got["product"].value, got["product"].uncertainty) == ("6", "0.2525")


def test_derivations_on_derivations(spark):
    chain = [
        ("D2", "quotient", [("3.62 元/股", "E5"), "D1"]),
        ("D1", "quotient", [("30,050,162.75", "E3"), ("16,498,650", "E4")]),
        ("D3", "product", ["D2", ("30%", "E5")]),
        ("D4", "product", ["D3", ("30%", "E5")]),
        ("D5", "product", [("30%", "E5"), "D4"]),
        ("D6", "sum", ["D5", "D5"]),
    ]
    got = derive(spark, chain)
    assert (got["D1"].display, got["D2"].display, got["D3"].depth) == ("1.82 元/股", "1.99倍", 3)
    assert got["D2"].formula == "3.62 元/股 / [D-B] 1.82 元/股" and got["D2"].depends_on == ["D-B"] and got["D2"].depth == 2
    assert got["D4"].reason == "derivation chain is 4 deep, over the limit of 3"
    assert got["D5"].reason == "operand depends on derivation 'D4', which did not validate"
    assert got["D6"].reason == "operand depends on derivation 'D5', which did not validate"


def test_reasons(spark):
    got = derive(
        spark,
        [
            ("A", "sum", ["B", WAN]),
            ("B", "sum", ["C", WAN]),
            ("C", "sum", ["A", WAN]),
            ("self", "sum", ["self", WAN]),
            ("behind", "sum", [WAN, "A"]),
            ("between", "sum", ["A", "self"]),
            ("one", "sum", [WAN]),
            ("none", "sum", []),
            ("unknown", "sum", [WAN, "Z"]),
            ("invented", "sum", [("9,999.99 万元", "E1"), SUM]),
            ("other document", "ratio", [("3.62 元/股", "E1"), SUM]),
            ("nowhere", "sum", [("1 万元", "E9"), SUM]),
            ("no number", "sum", [("many", "E1"), SUM]),
            ("date", "sum", [("2026年8月13日", "E5"), SUM]),
            ("mixed", "sum", [WAN, ("3.62 元/股", "E5")]),
            ("currencies", "quotient", [WAN, ("5 美元", "E5")]),
            ("squared", "product", [WAN, SUM]),
            ("zero", "quotient", [WAN, ("0.00 元", "E5")]),
            ("three", "quotient", [WAN, SUM, SUM]),
            ("op", "power", [WAN, SUM]),
            ("after", "sum", ["zero", WAN]),
        ],
    )
    assert all(r.value is None and r.display is None and r.depth is None for r in got.values())
    cycle = "derivation cycle: {} takes part in a circular reference"
    broken = "operand depends on derivation '{}', which did not validate"
    assert {k: r.reason for k, r in got.items()} == {
        **{k: cycle.format(k) for k in ("A", "B", "C", "self")},
        "behind": broken.format("A"),
        "between": broken.format("A"),
        "one": "a derivation needs at least two operands",
        "none": "a derivation needs at least two operands",
        "unknown": "operand references unknown derivation 'Z'",
        "invented": "operand '9,999.99 万元' does not occur in any quote from evidence 'E1'’s document",
        "other document": "operand '3.62 元/股' does not occur in any quote from evidence 'E1'’s document",
        "nowhere": "operand '1 万元' cites unknown evidence 'E9' and occurs in no cited quote",
        "no number": "operand 'many' contains no number",
        "date": "operand '2026年8月13日' is not numeric",
        "mixed": "sum needs operands in one unit, got CNY, CNY/unit",
        "currencies": "cannot divide CNY^1 by USD^1",
        "squared": "product has no representable dimension (CNY^2)",
        "zero": "divisor interval spans zero at the precision it was printed; the quotient is unbounded",
        "three": "quotient takes exactly two operands",
        "op": "unknown operation 'power'",
        "after": broken.format("zero"),
    }
    assert got["op"].derived_id == "D-T"


def test_no_proposals(spark):
    empty = spark.createDataFrame([], "run string, proposal_id string, position int, op string, precision int, operands array<struct<display:string,evidence_id:string,derived_id:string>>")
    evidence = spark.createDataFrame([], "run string, evidence_id string, position int, document_id string, quote string")
    assert derivations.compute_derivations(empty, evidence).collect() == []


def test_totals_are_no_years(spark, tmp_path):
    """Totals that would be bare years as well, in every form, against the SQL."""
    totals = [1899.0, 1900.0, 1999.0, 2000.0, 2099.0, 2100.0, 2100.5, 1000.0, 499999.99]
    rows = [(169 * k + i, k % 4, t) for k, t in enumerate(totals) for i in range(169)] + [(169 * (k + 9) + i, (k + 1) % 4, t) for k, t in enumerate(totals) for i in range(169)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("swept_figures", "bound_figures"):
        want = con.sql(verifying.ORACLES[name])
        got = verifying.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_a_figure_is_found_once(spark):
    texts = spark.range(2).select("id", F.col("id").cast("string").alias("text")).repartition(1)
    found = exploded(texts.select("id", figures(F.col("text")).alias("a")), "a")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
