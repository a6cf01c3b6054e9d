"""Text expressions and sources on small rows."""

import pytest
from pyspark.sql import functions as F

from spark_filings.functions import text as t
from spark_filings.operators import checks, reports
from spark_filings.plans import checking, claiming, retrieval, sourcing
from spark_filings.sources import feeds, filings


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_passages(spark):
    got = one(spark, t.split_passages, "甲。乙！？丙\n a; b;", None)
    assert got == [["甲。", "乙！？", "丙", "a;", "b;"], []]


def test_units(spark):
    assert one(spark, t.semantic_units, "It's 12.5 净利润 it's 元", None) == [["it's", "12.5", "净利", "利润", "元"], []]


def test_fragments(spark):
    long = "，".join("字" * 50 for _ in range(4))
    got = one(spark, t.quotable_fragments, long, "short", "x" * 200)
    assert "".join(got[0]) == long and all(len(x) <= 140 for x in got[0]) and len(got[0]) == 2
    assert got[1:] == [["short"], ["x" * 200]]


def test_decimal(spark):
    assert one(spark, t.canonical_decimal, "1,234.500", "-0.0", "007", "1e5", "12.", None) == ["1234.5", "0", "7", None, None, None]


def test_letters(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,)], "n long")
    assert [r[0] for r in df.select(t.letter_id(F.col("n"), "C")).collect()] == ["C-A", "C-Z", "C-AA", "C-ZZ", "C-AAA"]


def test_letters_of_large_numbers(spark):
    def letters(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return "C-" + out

    numbers = [12_356_629, 12_356_630, 321_272_405, 321_272_406, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r[0] for r in df.select(t.letter_id(F.col("n"), "C")).collect()] == [letters(n) for n in numbers]


def test_claim_ids_are_distinct(spark, tmp_path):
    lines = [(1, 1), (20_001, 1), (40_001, 2), (50_000_000, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert len({r.claim_id for r in sourcing.claim_ids(spark, str(tmp_path)).collect()}) == len(lines)


def test_html(spark):
    page = "<p>a&nbsp;&amp;  b &bogus;</p><script>x</script><div>c<br/>d</div>"
    assert one(spark, t.html_to_text, page, "no tags &amp;", None) == ["a & b &bogus;\n c\nd".replace("\n c", "\nc"), "no tags &amp;", None]


def test_html_pieces(spark):
    pages = ["<div>a\u00a0\u00a0b </div><!-- <p>x</p> --><STYLE a>y</style>c &LT;d&gt; &amp;lt; & e", "<p>1</p>\n \n\n<p>2</p>", "a < b <br>c"]
    assert one(spark, t.html_to_text, *pages) == ["a b\nc <d> &lt; & e", "1\n\n2", "a < b\nc"]


def test_nearest_and_supporting(spark, monkeypatch):
    """The nearest fragment, the one that reports an absence, and the same passages by either way to meet them."""
    docs = spark.createDataFrame([(1, "The auditor signed the report of the company. The fee of the auditor is not yet stated."), (2, "An auditor report, signed in full; nothing else here."), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Which auditor signed the report?"), (8, "What fee is due"), (9, "unheard words"), (10, "")], "item_id long, text string")

    def found():
        near = {r.item_id: (r.doc_id, r.fragment, r.n_shared) for r in retrieval.nearest_fragments(docs, asked).collect()}
        told = {r.item_id: (r.doc_id, r.n_markers, r.n_shared) for r in retrieval.supporting_fragments(docs, asked).collect()}
        return near, told

    first = found()
    assert first == ({7: (2, "An auditor report, signed in full;", 3)}, {7: (1, 1, 3), 8: (1, 1, 1)})
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert found() == first


def test_windows(spark):
    from spark_filings.operators import windows

    def by_hand(text, size, carry):
        if len(text) <= size:
            return [text]
        out, held = [], ""
        for passage in (x for x in text.split(" ")):
            for piece in (passage[k : k + size] for k in range(0, len(passage), size)):
                if held and len(held) + len(piece) > size:
                    out.append(held)
                    held = held[-carry:]
                held += piece
        return [*out, held] if held.strip() else out

    texts = ["short", "", None, "aaaa; " + "b" * 25 + "; cc; dddddd; e;", "x" * 40]
    rows = windows.window_documents(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", 12, 3).orderBy("k", "index").collect()
    for k, x in enumerate(texts):
        want = by_hand(x or "", 12, 3)
        assert [(r.window, r.total) for r in rows if r.k == k] == [(w, len(want)) for w in want], (k, want)
    held = spark.createDataFrame([(1, i, 4, w) for i, w in enumerate(("front", "some words", "apples and pears", "pears"), 1)], "k int, index long, total long, window string")
    focus = spark.createDataFrame([("apples pears",), ("pears",)], "question string")
    assert [r["index"] for r in windows.select_windows(held, "k", focus, 2).collect()] == [1, 3]


def test_tasks(spark, tmp_path):
    import json

    from spark_filings.operators import tasks

    for name, body in {"A/task.json": {"id": "A", "lang": "zh-CN"}, "A/task.en.json": {"id": "A", "lang": "en"}, "A/gold.json": {"must_refuse": True}, "A/gold.en.json": {"must_refuse": False}, "T/task.json": {"id": "T", "lang": "en", "trap": True}, "T/gold.json": {"forbidden": ["x"]}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    rows = tasks.read_tasks(spark, str(tmp_path))
    gold = {(r.folder, r.lang): (r.must_refuse, r.forbidden) for r in tasks.read_gold(spark, str(tmp_path)).collect()}
    assert gold == {("A", "zh-CN"): (True, None), ("A", "en"): (False, None), ("T", "en"): (None, ["x"])}
    chosen, unknown = tasks.select_tasks(rows)
    assert chosen.count() == 2 and unknown.count() == 0
    chosen, unknown = tasks.select_tasks(rows, ["T", "Z"], ["en"])
    assert [r.id for r in chosen.collect()] == ["T"] and [r.id for r in unknown.collect()] == ["Z"]


def test_scores_of_repeated_files(spark, tmp_path):
    from spark_filings.streaming import scores

    rows = spark.createDataFrame([("r", 1, "a"), ("r", 2, "bb")], "run string, task int, output string")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        scores.stream_scores(spark, f"{tmp_path}/in", rows.schema, lambda b: b.select("run", "task", F.length("output").alias("score")), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, scores.latest_scores(spark, f"{tmp_path}/out", ["run", "task"]).select("run", "task", "score").collect())) == [("r", 1, 1), ("r", 2, 2)]


def test_titles(spark):
    assert one(spark, t.title_of, "\n  First line \nsecond", "", None) == ["First line", "", ""]


def test_read_filings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("\n Title \nbody")
    (tmp_path / "two.md").write_text("x")
    (tmp_path / "blank.txt").write_text(" \n")
    rows = {r.document_id: r.title for r in filings.read_filings(spark, str(tmp_path)).collect()}
    assert rows == {"a/one.txt": "Title", "two.md": "x"}


def test_responses(spark):
    raw = ['{"output": "a"}', '{"choices": [{"message": {"content": "b"}}]}', "plain", '"quoted"', " ", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    rows = filings.parse_responses(df).orderBy("i").collect()
    assert [r.output for r in rows[:4]] == ["a", "b", "plain", "quoted"]
    assert [r.error is None for r in rows] == [True] * 4 + [False] * 2


def test_grades(spark):
    df = spark.createDataFrame([(["blue", "red", "amber"],), ([None],), ([],), (["odd", "unknown"],)], "g array<string>")
    assert [r[0] for r in df.select(filings.worst_grade(F.col("g"))).collect()] == ["red", None, None, "odd"]


def test_grades_of_a_group(spark):
    rows = [(1, 3, "blue"), (1, 2, "red"), (1, 1, None), (2, 1, None), (3, 2, "unknown"), (3, 1, "odd"), (4, 1, "odd"), (4, 2, "amber")]
    df = spark.createDataFrame(rows, "u int, k int, g string").groupBy("u").agg(filings.worst_of_group(F.col("g"), F.col("k")).alias("w"))
    assert dict(map(tuple, df.collect())) == {1: "red", 2: None, 3: "odd", 4: "amber"}


def test_hot_names_are_numbered_by_many_tasks(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("n"), F.col("id") % 3)).alias("name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = filings.disambiguate_ids(df.repartition(8), "name", ["id"]).withColumn("part", F.spark_partition_id())
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.id: r.name for r in rows}
    assert len({r.part for r in rows if r.id % 10 < 8}) > 1
    seen, want = {}, {}
    for i in range(20_000):
        name = "hot" if i % 10 < 8 else f"n{i % 3}" if i % 10 == 8 else None
        k = seen[name] = seen.get(name, 0) + 1
        want[i] = name if k == 1 else f"{name}#{k}" if name else str(k)
    assert got == want


def test_no_feed_is_one_row(spark, tmp_path):
    events = spark.range(5000).select(F.col("id").alias("event_id"), F.lit(2).alias("user_id"), F.lit("view").alias("event_type"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("2000-01-01").cast("date").alias("o_orderdate"), F.lit("F").alias("o_orderstatus"), F.lit("p").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    longest = []
    parse, explode = feeds.parse_announcements, feeds.explode_submissions

    def parsed(df, *args):
        longest.append(df.agg(F.max(F.size(F.split("body", "event_type")))).first()[0])
        return parse(df, *args)

    def exploded(df, *args):
        longest.append(df.agg(F.max(F.size("recent.form"))).first()[0])
        return explode(df, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(feeds, "parse_announcements", parsed)
        patch.setattr(feeds, "explode_submissions", exploded)
        assert claiming.announcements(spark, str(tmp_path)).count() == 5000
        assert [r.document_id for r in claiming.submissions(spark, str(tmp_path)).orderBy("k").collect()] == [f"edgar:1:00{k}:p.htm" for k in (1, 2, 3, 4, 5)]
    assert max(longest) <= 1001


def test_open_passages(spark):
    df = spark.createDataFrame([(1, 0, "open"), (1, 1, "closed;"), (1, 2, "last"), (2, 0, "x" * 239), (2, 1, "y")], "d int, k int, p string")
    rows = checks.join_open(df, ["d"], "k", "p").orderBy("d", "k").collect()
    assert [r.joined for r in rows] == ["open\nclosed;", "closed;", "last", "x" * 239, "y"]


def test_points(spark):
    answers = spark.createDataFrame([(1, 1, "however net loss rose\nother"), (2, 1, "net loss rose"), (3, 9, "x")], "answer_id int, task int, output string")
    points = spark.createDataFrame([(1, 1, "net loss rose")], "task int, point_id int, point string")
    scores = {r.answer_id: r.score for r in checks.points_covered(answers, points, "task", 0.25, "(?i)however").collect()}
    assert scores == {1: 1.0, 2: 0.0, 3: 1.0}


def test_points_of_the_whole_answer(spark):
    answers = spark.createDataFrame([(1, 1, "net\nloss"), (2, 1, "net\nother"), (3, 1, None), (4, 9, "x")], "answer_id int, task int, output string")
    points = spark.createDataFrame([(1, 1, "net loss rose again"), (1, 2, "..."), (1, 3, "deep water")], "task int, point_id int, point string")
    got = {r.answer_id: (r.n_points, r.n_covered) for r in checks.points_covered(answers, points, "task", 0.5, whole=True).collect()}
    assert got == {1: (3, 2), 2: (3, 1), 3: (3, 1), 4: (0, 0)}


def test_counterevidence_needs_a_mark(spark):
    texts = ["the net loss rose", "on the other hand net loss", "风险 net loss", "however\nnet loss rose", "uncertain net", "but however other"]
    answers = spark.createDataFrame([(i, 1, x) for i, x in enumerate(texts)], "answer_id int, task int, output string")
    points = spark.createDataFrame([(1, 1, "net loss rose again")], "task int, point_id int, point string")
    got = {r.answer_id: r.n_covered for r in checks.points_covered(answers, points, "task", 0.25, checking.COUNTER_MARKS).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


def test_candidate_fragments(spark):
    long = ",".join(["net loss rose again " + "x" * 60] * 3)
    docs = spark.createDataFrame([(1, "tiny.;\nnet loss; net loss rose again\nnet loss rose 5"), (2, long), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "net loss rose again"), (2, "?"), (3, None), (4, "Это")], "item_id int, text string").select("item_id", t.semantic_units(F.col("text")).alias("units"))
    at = ("passage_no", "fragment_no")
    rows = retrieval.candidate_passages(retrieval.fragments_of(docs), asked, 3, at, True).collect()
    got = {i: [(r.doc_id, r.passage_no, r.fragment_no, r.points) for r in sorted(rows, key=lambda r: r.place) if r.item_id == i] for i in (1, 2, 3, 4)}
    assert got[1] == [(1, 3, 0, 22), (1, 2, 0, 20), (2, 0, 2, 20)]
    assert got[2] == got[3] == got[4] == [(1, 3, 0, 27), (1, 1, 0, 20), (1, 2, 0, 20)]
    plain = retrieval.candidate_passages(retrieval.fragments_of(docs), asked, 2, at).where("item_id = 2").orderBy("place").collect()
    assert [(r.passage_no, r.points) for r in plain] == [(1, 20), (3, 20)]


def test_quotes(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, "a" * 40), (3, None)], "id int, text string")
    quotes = spark.createDataFrame([(7, "c d"), (8, "a" * 30), (9, ""), (10, "zz")], "q int, text string")
    assert sorted(map(tuple, checks.quoted_in(texts, "id", quotes, "q").collect())) == [(7, 1), (8, 2)]


def test_report_counts_missing_dimensions_for_nothing(spark):
    df = spark.createDataFrame([("en", 1.0, None), ("fr", 0.0, 0.5)], "lang string, a double, b double")
    rows = {(r.dimension, r.lang): (r.n, r["mean"]) for r in reports.build_report(df, ["a", "b"]).collect()}
    assert rows["a", None] == (2, 0.5) and rows["b", None] == (1, 0.5) and ("b", "en") not in rows
