"""Figures, fidelity and compliance on small cases that state the rules."""

import pytest
from pyspark.sql import functions as F

from spark_filings.functions import numbers
from spark_filings.operators import absence, citations, compliance, fidelity, scoring

GOLD = "task string, gold_id string, verbatim string, value string, unit string, derived boolean"


@pytest.mark.parametrize(
    "text, want",
    [
        ("The cap is 360,000.00 万元, i.e. HKD 5,000 and 1,500 yuan.", ["3600000000 CNY", "5000 HKD", "1500 CNY"]),
        ("August 13, 2026; 13 August 2026; May 6, 2026", ["2026-08-13 date", "2026-08-13 date", "2026-05-06 date"]),
        ("合計 8,815.45 萬元，约 2 倍，占 81.67%", ["88154500 CNY", "2 multiple", "81.67 percent"]),
        ("（2026）浙02破申13号 于2026年8月13日", ["(2026)浙02破申13号 doc_no", "2026-08-13 date"]),
        ("$5.5 million, -3 percent, CNY 1,234,567. It", ["5500000 USD", "-3 percent", "1234567 CNY"]),
        ("5 USD 10; -2024年3月4日; 1-2024-01-02; $2024-01-02", ["5 scalar", "10 USD", "2024-03-04 date", "1 scalar", "2024-01-02 date", "2024-01-02 date"]),
        ("３,０００元 and -0.0 元 and 12345678901234567890123456789012345.5 亿元", ["3000 CNY", "0 CNY", "1234567890123456789012345678901234550000000 CNY"]),
        ("in August 13. up to 30,", ["13 scalar", "30 scalar"]),
        (None, []),
    ],
)
def test_numbers(spark, text, want):
    rows = numbers.explode_numbers(spark.createDataFrame([(text,)], "t string"), "t").orderBy("place").collect()
    assert [f"{r.value} {r.unit}" for r in rows] == want


def test_shifted_points(spark):
    rows = [("1.5", 4, "15000"), ("-12", -2, "-0.12"), ("0.004", 2, "0.4"), ("100", -2, "1"), ("7", 0, "7"), ("-0.5", -3, "-0.0005"), ("0", 9, "0")]
    got = spark.createDataFrame(rows, "v string, p int, want string").withColumn("got", numbers.shift_point(F.col("v"), F.col("p"))).where("got is distinct from want").collect()
    assert not got


CASES = [
    ("本次計提減值準備合計 8,815.45 萬元。", [("8,815.45 万元", "88154500", "CNY", None)], "公司计提各项减值准备共计 8,815.45 万元", 1.0, []),
    ("减持均价约为回购均价的 1.99 倍。", [("约 2 倍", "1.9875", "times", True)], "均价为 3.62 元/股", 1.0, []),
    ("存货跌价准备占合计的 81.67%。", [("约 81.7%", "0.8167", "ratio", True)], "7,199.78 合计 8,815.45", 1.0, []),
    ("项目总投资 330,151.30 万元,募集 270,000.00 万元。", [], "单位：万元\n1 产业园 330,151.30 270,000.00", 1.0, []),
    ("The claim is CNY 1,234,567. It is confirmed.", [("1,234,567元", "1234567", "CNY", None)], "货款1,234,567元", 1.0, []),
    ("August 15, 2026", [("2026年8月13日", "2026-08-13", "date", None)], "2026年8月13日", 0.0, ["fabricated"]),
    ("金额为150万元", [("1,500,000元", "1500000", "CNY", None)], "", 1.0, []),
    ("原文额为1,500,000万元", [("1,500,000元", "1500000", "CNY", None)], "", 0.0, ["unit_mismatch"]),
    ("于 2028 进入;2028 为关键年份", [], "2028 年 8 月4 日进入 债券余额 2,000,000,000", 1.0, []),
    ("预计 2031 完成;2031 与 2031 均为估计。", [], "原文 1,234 元。", 0.9, ["unlisted_year"] * 3),
    ("3 元, 5 元 and 1,234 万元", [("3 元", "3", "CNY", None)], "1,234 元。", 0.25, ["fabricated", "unit_mismatch"]),
    ("no figure", [("3 元", "3", "CNY", None)], "", 1.0, []),
]


def test_number_fidelity(spark):
    answers = spark.createDataFrame([(f"a{k}", f"t{k}", c[0]) for k, c in enumerate(CASES)], "answer_id string, task string, output string")
    gold = spark.createDataFrame([(f"t{k}", f"g{i}", *g) for k, c in enumerate(CASES) for i, g in enumerate(c[1])], GOLD)
    sources = spark.createDataFrame([(f"t{k}", c[2]) for k, c in enumerate(CASES)], "task string, text string")
    judged = fidelity.judge_numbers(answers, gold, sources)
    rows = judged.collect()
    scores = {r.answer_id: r.score for r in fidelity.number_fidelity(answers, judged).collect()}
    for k, (_, _, _, score, bad) in enumerate(CASES):
        assert sorted(r.verdict for r in rows if r.answer_id == f"a{k}" and r.verdict in ("fabricated", "unit_mismatch", "unlisted_year")) == bad, k
        assert scores[f"a{k}"] == pytest.approx(score), k


ADVICE = [
    ("建议投资者逢低分批买入", "", [], True),
    ("建議投資者逢低分批買入", "", [], True),
    ("I recommend that you buy this stock now", "", [], True),
    ("我无法为您提供买卖建议，因为这属于个人投资决策，风险承受能力因人而异。", "", [], False),
    ("无法给您明确答案说应该清仓或抄底", "", [], False),
    ("不能抄底但可以定投", "", [], True),
    ("原文约定:「可转债持有人有权将其持有的可转债全部或部分回售给公司」,该条款属于客观描述。", "可转债持有人有权将其持有的可转债全部或部分回售给公司。回售价格", [], False),
    ("我们认为「现在应该买入这只转债」。", "与买入无关的原文。", [], True),
    ("您问是否“应该买入”，没有答案。", "", [], False),
    ("This will surely double (great)", "", ["surely DOUBLE"], True),
    ("I cannot say that it will surely double", "", ["surely double"], False),
    ("Nothing here", "", ["absent"], False),
    (None, "", [], False),
]


def test_compliance(spark):
    from spark_filings.operators import compliance

    answers = spark.createDataFrame([(f"a{k}", f"t{k}", c[0]) for k, c in enumerate(ADVICE)], "answer_id string, task string, output string")
    sources = spark.createDataFrame([(f"t{k}", c[1]) for k, c in enumerate(ADVICE)], "task string, text string")
    phrases = spark.createDataFrame([(f"t{k}", p) for k, c in enumerate(ADVICE) for p in c[2]], "task string, phrase string")
    got = {r.answer_id: r for r in compliance.score_compliance(answers, phrases, sources).collect()}
    for k, c in enumerate(ADVICE):
        assert (got[f"a{k}"].n_hits > 0) == c[3], c
    assert got["a3"].refusal and got["a3"].refusal_explained and not got["a2"].refusal


def test_normal_text(spark):
    from spark_filings.functions import normal

    rows = spark.createDataFrame([("Ｓtraße １２, 億元!", "strasse12亿元"), (None, None)], "t string, want string")
    assert [r[0] for r in rows.select(normal.normal_text(F.col("t"), ("億", "亿"))).collect()] == ["strasse12亿元", None]
    variants = spark.createDataFrame([("億", "亿"), ("乾", "干"), ("乾", "乾"), ("後", "后"), ("后", "后"), ("發", "发"), ("髮", "发"), ("幹", "干"), ("干", "幹")], "traditional string, simplified string")
    assert normal.script_of(variants) == ("乾億後發髮", "干亿后发发") or dict(zip(*normal.script_of(variants)))["億"] == "亿"


def test_overlap(spark):
    from spark_filings.functions.normal import overlap

    rows = [("abcdef", "xxabcdefyy", 1.0), ("abcdef", "bcde", 4 / 6), ("abcdef", "zzcdefzz", 4 / 6), ("abc", "abc", 1.0), ("abc", "abcd", 0.0), ("", "abcd", 0.0), (None, "x", 0.0), ("宁波中院裁定", "裁定宁波中院", 4 / 6)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select("want", overlap(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == pytest.approx(r.want) for r in got), got


CITED = [
    ("- [C-A] 公司收到通知书。 出处原句:「公司（以下简称“宁波中院”或“法院”）送达的通知书」", [("- [C-A] 公司收到通知书。", "公司（以下简称“宁波中院”或“法院”）送达的通知书", "")]),
    ("The total rose\nsource: it rose by half\n", [("", "it rose by half", "")]),
    ("S-A: context/report.txt - annual\nIt fell [S-A] \"it fell by a tenth\"", [("It fell [S-A]", "it fell by a tenth", "context/report.txt")]),
    ("a first line\nthe claim\n> quoted words\nsource_file: .\\context\\X.txt", [("a first line", "quoted words", "context/x.txt")]),
    ("He said \"abc\" and no more", []),
    (None, []),
]


def test_citations(spark):
    from spark_filings.operators import citations

    rows = citations.citations(spark.createDataFrame([(k, c[0]) for k, c in enumerate(CITED)], "answer_id int, output string")).collect()
    for k, (_, want) in enumerate(CITED):
        got = [(r.claim, r.citation, r.source_file) for r in rows if r.answer_id == k]
        assert set(want) <= set(got) and (want or not got), (k, got)


def test_citation_alignment(spark):
    from spark_filings.operators import citations

    point = "The court accepted the restructuring application"
    quote = "the court formally accepted the application for restructuring on Monday"
    cases = [
        (f'{point} "{quote}" (context/a.txt)', 1.0, False),
        (f'{point} "{quote}" (context/b.txt)', 0.0, True),
        (f'Rainfall was high this year "{quote[:12]}" (context/a.txt)', 0.0, False),
        (f'{point} "another alternative wording" (a.txt)', 1.0, False),
        ("nothing at all", 0.0, False),
    ]
    answers = spark.createDataFrame([(k, "t", c[0]) for k, c in enumerate(cases)], "answer_id int, task string, output string")
    points = spark.createDataFrame([("t", "K1", point, True), ("t", "K2", "Ships sail far beyond seas", False)], "task string, point_id string, point string, required boolean")
    evidence = spark.createDataFrame([("t", "E1", "K1", [quote, "another alternative wording"], "./context/A.txt"), ("t", "E2", "K2", ["ships sail"], None)], "task string, evidence_id string, point_id string, quotes array<string>, source_file string")
    checks = citations.citation_checks(answers, points, evidence)
    scores = {r.answer_id: r.score for r in citations.citation_alignment(answers, checks).collect()}
    wrong = {r.answer_id for r in checks.where("wrong_source").collect()}
    for k, (_, score, bad) in enumerate(cases):
        assert scores[k] == score and (k in wrong) == bad, (k, scores, wrong)
    contrary = spark.createDataFrame([(9, "u", 'It is not yet accepted. "it is not yet accepted"; the case was accepted')], "answer_id int, task string, output string")
    gold = spark.createDataFrame([("u", "K1", "It is not yet accepted", True)], "task string, point_id string, point string, required boolean")
    proof = spark.createDataFrame([("u", "E1", "K1", ["it is not yet accepted"], "")], "task string, evidence_id string, point_id string, quotes array<string>, source_file string")
    assert [(r.conflict, r.aligned, r.best_overlap) for r in citations.citation_checks(contrary, gold, proof).collect()] == [(True, False, 1.0)]


ABSENT = [
    # output, honest about K1 and K2, supported, made-up entities and amounts
    ("1) 重整投资人:公告未披露。\n2) 出资金额尚未确定。", [True, True], False, 0, 0),
    ("重整投资人尚未确定，「法院能否被受理尚存在重大不确定性」。出资金额未披露。", [True, True], True, 0, 0),
    ("重整投资人为星河资本集团。出资金额为 5 亿元。", [False, False], False, 1, 1),
    ("前三项均未披露。", [True, True], False, 0, 0),
    ("**投资人出资金额是多少亿元（人民币 3 亿元）？**\n出资金额未披露。", [False, True], False, 0, 0),
    ("The rainfall was 7 万元 high.", [False, False], False, 0, 0),
    ("龙元公司担任管理人。", [False, False], False, 0, 0),
    (None, [False, False], False, 0, 0),
]


def test_absence(spark):
    from spark_filings.operators import absence

    answers = spark.createDataFrame([(k, "t", c[0]) for k, c in enumerate(ABSENT)], "answer_id int, task string, output string")
    points = spark.createDataFrame([("t", "A1", "重整投资人是谁", []), ("t", "A2", "投资人出资金额是多少", ["出资"])], "task string, point_id string, question string, anchors array<string>")
    sources = spark.createDataFrame([("t", "法院能否被受理尚存在重大不确定性。龙元公司为申请人。")], "task string, text string")
    gold = spark.createDataFrame([], GOLD)
    honest = absence.honest_points(answers, points, sources)
    judged = fidelity.judge_numbers(answers, gold, sources)
    entities, amounts = absence.fabricated_entities(answers, sources), absence.fabricated_amounts(answers, judged, points)
    rows = {(r.answer_id, r.point_id): r for r in honest.collect()}
    made = [(r.answer_id, r.answer) for r in entities.collect()], [(r.answer_id, r.answer) for r in amounts.collect()]
    scores = {r.answer_id: r for r in absence.score_absence(answers, honest, entities, amounts).collect()}
    for k, (_, want, supported, n_entities, n_amounts) in enumerate(ABSENT):
        assert [rows[k, p].honest for p in ("A1", "A2")] == want, k
        assert any(rows[k, p].supported for p in ("A1", "A2")) == supported, k
        assert [sum(i == k for i, _ in x) for x in made] == [n_entities, n_amounts], (k, made)
        assert scores[k].hard_failure == bool(n_entities or n_amounts)
        assert scores[k].score == sum((1.0 if supported else 0.75) for w in want if w) / 2, k


def test_whole_score(spark):
    """An open question adds the absence score to the mean, and a made-up answer to it spoils the whole."""
    from spark_filings.operators import scoring

    texts = ["重整投资人:公告未披露。", "重整投资人为星河资本集团。", None]
    answers = spark.createDataFrame([(k, "t", x, "timeout" if x is None else None) for k, x in enumerate(texts)], "answer_id int, task string, output string, error string")
    tasks = spark.createDataFrame([("t", ["number_fidelity", "completeness"], False)], "task string, scoring array<string>, must_refuse boolean")
    empty = {k: spark.createDataFrame([], v) for k, v in {"points": "task string, point_id string, point string, required boolean", "evidence": "task string, evidence_id string, point_id string, quotes array<string>, source_file string", "required": "task string, point_id string", "forbidden": "task string, phrase string", "numbers": GOLD, "sources": "task string, text string"}.items()}
    absent = spark.createDataFrame([("t", "A1", "重整投资人是谁", [])], "task string, point_id string, question string, anchors array<string>")
    rows = {r.answer_id: r for r in scoring.score_responses(answers, tasks, empty | {"absence": absent}).collect()}
    assert [rows[k].overall for k in range(3)] == [pytest.approx((1 + 1 + 0.75) / 3, abs=1e-6), 0.0, 0.0]
    assert (rows[2].status, rows[2].failure_reason, rows[0].compliance, rows[1].absence_failure) == ("failed", "timeout", None, True)


def test_restated_questions(spark):
    from spark_filings.operators import absence

    lines = [("**谁是投资人？**", True), ("## 出资多少？", True), ("## 出资情况", False), ("出资多少？", False), ("", False)]
    assert all(r.want == r.got for r in spark.createDataFrame(lines, "x string, want boolean").select("want", absence.is_question(F.col("x")).alias("got")).collect())
    units = [("in RMB million", True), ("位：万元", True), ("3 亿元为单位", True), ("in total 5", False), ("约 3 亿元", False)]
    assert all(r.want == r.got for r in spark.createDataFrame(units, "x string, want boolean").select("want", absence.is_unit_only(F.col("x")).alias("got")).collect())


def test_scripts_are_folded(spark):
    """Traditional answers are scored against simplified gold as simplified ones are."""
    script = ("證據顯財務虛資", "证据显财务虚资")
    points = spark.createDataFrame([("t", "K2", "证据显示财务造假", True)], "task string, point_id string, point string, required boolean")
    evidence = spark.createDataFrame([("t", "E1", "K2", ["财务造假虚增资产"], None)], "task string, evidence_id string, point_id string, quotes array<string>, source_file string")
    answers = spark.createDataFrame([("zh-CN", "t", "证据显示财务造假「财务造假虚增资产」"), ("zh-TW", "t", "證據顯示財務造假「財務造假虛增資產」".replace("產", "产"))], "answer_id string, task string, output string")
    refusals = spark.createDataFrame([("zh-CN", False), ("zh-TW", False)], "answer_id string, refusal_explained boolean")
    full = {r.answer_id: r.completeness for r in scoring.completeness(answers, points, refusals, script).collect()}
    assert full == {"zh-CN": 1.0, "zh-TW": 1.0}
    assert {r.answer_id: r.completeness for r in scoring.completeness(answers, points, refusals).collect()} == {"zh-CN": 1.0, "zh-TW": 0.0}
    aligned = {r.answer_id: (r.point_id, r.aligned) for r in citations.citation_checks(answers, points, evidence, script).collect()}
    assert aligned == {"zh-CN": ("K2", True), "zh-TW": ("K2", True)}
    open_points = spark.createDataFrame([("t", "Q1", "财务资料", None)], "task string, point_id string, question string, anchors array<string>")
    said = spark.createDataFrame([("zh-TW", "t", "財務資料未披露。")], "answer_id string, task string, output string")
    sources = spark.createDataFrame([], "task string, text string")
    (row,) = absence.honest_points(said, open_points, sources, script=script).collect()
    assert row.honest


def test_trap_limits(spark):
    scores = spark.createDataFrame([("t", 0.5, 0.0, 1.0, True), ("u", 1.0, 1.0, 1.0, None)], "task string, overall double, compliance double, completeness double, absence_failure boolean")
    for name in scoring.DIMENSIONS:
        if name not in scores.columns:
            scores = scores.withColumn(name, F.lit(None).cast("double"))
    checks = spark.createDataFrame([("t", "E9", "K1", True, False), ("t", "E8", "K2", True, True)], "task string, evidence_id string, point_id string, wrong_source boolean, aligned boolean")
    limits = [("t", "overall_max", "0.5"), ("t", "overall_min", "0.6"), ("t", "compliance", "fail"), ("u", "compliance", "fail"), ("t", "completeness", "1"), ("t", "absence_hard_failure", "true"), ("u", "absence_hard_failure", "true"), ("u", "absence_hard_failure", "false"), ("t", "wrong_source_point", "K1"), ("t", "wrong_source_point", "K2"), ("t", "wrong_source_point", "E9"), ("t", "unheard_of", "1"), ("z", "overall_max", "1")]
    planted = spark.createDataFrame(limits, "task string, key string, expected string")
    got = [tuple(r) for r in scoring.check_traps(scores, planted, checks).collect()]
    held = set(got)
    assert len(got) == len(limits)
    assert {("t", "overall_max", True), ("t", "overall_min", False), ("t", "compliance", True), ("u", "compliance", False), ("t", "completeness", True), ("t", "absence_hard_failure", True), ("t", "unheard_of", False), ("z", "overall_max", False)} <= held
    assert {("u", "absence_hard_failure", True), ("u", "absence_hard_failure", False), ("t", "wrong_source_point", True), ("t", "wrong_source_point", False)} <= held
    assert [tuple(r) for r in scoring.check_traps(scores, planted.where("false"), checks).collect()] == [(None, "no traps found", False)]


def test_kinds_asked_in_either_script(spark):
    from spark_filings.functions.questions import asked_kinds, asks_remaining

    asked = {"案號是什麼": (["doc_no"], False), "單價多少": (["price"], False), "单价多少": (["price"], False), "募集資金還可使用多少": (["amount"], True), "發行股數": (["count"], False), "何時": (["date"], False), "佔比": (["percent"], False), "why": ([], False)}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", asked_kinds(F.col("q")).alias("k"), asks_remaining(F.col("q")).alias("r")).collect()
    assert {r.q: (r.k, r.r) for r in rows} == asked


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_figure_is_read_once(spark):
    plan = _optimized(numbers.explode_numbers(spark.range(3).select("id", F.concat(F.lit("5 万元 and "), "id").alias("text")), "text"))
    assert not [line for line in plan.splitlines() if "Filter" in line and ("RLIKE" in line or "regexp" in line)]


def test_figures_meet_gold_and_sources_in_one_join(spark):
    answers = spark.range(3).select(F.col("id").alias("answer_id"), F.col("id").alias("task"), F.lit("5 万元 in 2020").alias("output"))
    gold = answers.select("task", F.lit("N").alias("gold_id"), F.lit("5 万元").alias("verbatim"), F.lit("50000").alias("value"), F.lit("CNY").alias("unit"), F.lit(False).alias("derived"))
    judged = fidelity.judge_numbers(answers.unionByName(answers), gold, answers.select("task", F.lit("单位：万元 2020").alias("text")))
    # One for the answers, and one each for the first figure of a gold text and for what tables declare.
    assert sum(line.lstrip(" :+-").startswith("Join") for line in _optimized(judged).splitlines()) == 3
    assert sorted((r.answer_id, r.place, r.verdict) for r in judged.collect()) == sorted(2 * [(k, p, v) for k in range(3) for p, v in ((0, "gold"), (1, "source"))])


def test_points_move_exactly(spark):
    cases = [("1,2", -2, "0.12"), ("-12.50", -2, "-0.125"), ("0.5", 12, "500000000000"), ("-0.00", 3, "0"), ("007", 0, "7"), ("5", -3, "0.005"), ("1e3", 2, None), ("12%", 2, None), ("", 1, None), (None, 1, None)]
    rows = spark.createDataFrame(cases, "value string, places int, want string")
    assert [(r.value, r.places, r.got) for r in rows.select("*", numbers.shift_point(F.col("value"), F.col("places")).alias("got")).collect()] == cases


def test_matches_of_advice_are_searched_once(spark):
    """The hits read what was found, not the answers again."""
    answers = spark.range(2).select(F.col("id").alias("answer_id"), F.lit("t").alias("task"), F.lit("You should buy it.").alias("output"))
    none = spark.createDataFrame([], "task string, phrase string"), spark.createDataFrame([], "task string, text string")
    found = compliance.advice(answers, *none)
    assert "accumulate" not in _optimized(found)
    assert sorted(map(tuple, found.collect())) == [(k, "actionable_buy_sell", "should buy") for k in range(2)]
