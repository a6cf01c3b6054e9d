"""Replies of models, and sentences that speak against answers."""

import json
import random

import pytest

from spark_filings.functions.passages import sentences_of
from spark_filings.functions.replies import read_reply
from spark_filings.operators import adversative, replies


@pytest.mark.parametrize(
    "text, value, salvaged",
    [
        ('{"a": 1}', {"a": 1}, False),
        ('Here it is:\n```json\n[1, 2,]\n```\nDone {x}', [1, 2], False),
        ("```\n[1]\n``` and ```json\n[2]\n```", [1], False),
        ('Sure! {"a": "} not the end", "b": [1, 2, ], } thanks', {"a": "} not the end", "b": [1, 2]}, False),
        ('[{"q": "a \\" b"}, {"q": "c"}, {"q": "cut in a str', [{"q": 'a " b'}, {"q": "c"}], True),
        ('[{"n": 1}, {"n": 2}, {"n": 12', [{"n": 1}, {"n": 2}], True),
        ('{"items": [{"n": [1, 2]}, {"n": [3, 4], "m"', {"items": [{"n": [1, 2]}, {"n": [3, 4]}]}, True),
        ('```json\n{"items": [{"n": 1}, {"n"', {"items": [{"n": 1}]}, True),
        ('[[1], [2], "ends with a backslash \\', [[1], [2]], True),
        ('"text"', "text", False),
        ("12", 12, False),
    ],
)
def test_replies(text, value, salvaged):
    got, was, reason = read_reply(text)
    assert json.loads(got) == value and was == salvaged and reason is None


@pytest.mark.parametrize("text", ["", None, "no json", "[1, 2", '{"a": NaN}', "}{", '{"a": 1', "[" * 20])
def test_nothing_to_read(text):
    assert read_reply(text) == (None, False, f"model reply was not JSON: {(text or '')[:300]}")


def test_any_cut_keeps_complete_elements():
    rng = random.Random(1)
    items = [{"q": rng.choice(['a"b', "c]d", "{e", "\\", "中"]), "n": [k, {"m": k}]} for k in range(6)]
    for whole in (json.dumps(items), json.dumps({"items": items})):
        for cut in range(1, len(whole)):
            got, salvaged, reason = read_reply(whole[:cut])
            if got is None:
                continue
            value = json.loads(got)
            value = value["items"] if isinstance(value, dict) and "items" in value else value
            # All but the last element are the originals; the last may lack members that were cut off.
            assert salvaged and value[:-1] == items[: len(value) - 1] and (value[-1] == items[len(value) - 1] or set(value[-1]) <= {"q", "n"})


def test_reply_rows(spark):
    rows = [(1, '[{"text": "a", "n": 1}, {"text": "b"}]'), (2, '{"items": [{"text": "c", "n": 2}, {"text": "d'), (3, "nothing"), (4, None), (5, "[]"), (6, '{"other": 1}'), (6, '{"other": 1}')]
    out = replies.parse_replies(spark.createDataFrame(rows, "id int, reply string"), "reply", "struct<text:string,n:int>").collect()
    got = sorted((r.id, r.place, r.element and tuple(r.element), r.salvaged, r.reason) for r in out if r.place is not None)
    assert got == [(1, 0, ("a", 1), False, None), (1, 1, ("b", None), False, None), (2, 0, ("c", 2), True, None)]
    rest = sorted(((r.id, r.reason) for r in out if r.place is None), key=str)
    assert rest == [(3, "model reply was not JSON: nothing"), (4, "model reply was not JSON: "), (5, None), (6, None), (6, None)]


def targets(questions, evidence, documents, pattern_words, most=3, keep=4):
    """Brute force over all pairs."""
    out = []
    for run in {q[0] for q in questions}:
        ranked = []
        for _, question, position in [q for q in questions if q[0] == run]:
            own = [e for e in evidence if e[:2] == (run, question)]
            order = {}
            for _, _, p, d, s, e in sorted(own, key=lambda x: x[2]):
                for x in sentences_of(documents.get(d) or ""):
                    if x["region_start"] <= s < x["region_end"] and 0 <= s < e <= len(documents[d]):
                        order.setdefault((d, x["paragraph"]), p)
            hits, beside = [], []
            for (d, paragraph), p in order.items():
                inside = [x for x in sentences_of(documents[d]) if x["paragraph"] == paragraph]
                for i, x in enumerate(inside):
                    cited = any(e[3] == d and 0 <= e[4] < e[5] and e[4] < x["end"] and e[5] > x["start"] for e in own)
                    if not cited and len("".join(x["text"].split())) >= 8 and any(w in x["text"] for w in pattern_words):
                        hits.append(((p, d, x["start"]), d, x))
                        beside += [((p, d, x["start"], side), d, inside[j]) for side, j in ((0, i - 1), (1, i + 1)) if 0 <= j < len(inside)]
            if not hits:
                continue
            seen, kept = set(), []
            for _, d, x in sorted(hits, key=lambda h: h[0]) + sorted(beside, key=lambda h: h[0]):
                if (d, x["start"]) not in seen and len(kept) < keep:
                    seen.add((d, x["start"]))
                    kept.append((d, x["start"], any(h[1] == d and h[2] is x or h[1] == d and h[2]["start"] == x["start"] for h in hits)))
            ranked.append((-len(hits), position, question, kept))
        for rank, (n, _, question, kept) in enumerate(sorted(ranked)[:most]):
            out += [(run, question, rank + 1, -n, place, d, start, matched) for place, (d, start, matched) in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_adversative_targets(spark, seed):
    rng = random.Random(seed)
    words = ["公司明确反对该项安排", "反对", "双方均无异议并签署文件", "披露了全部资料内容", "交易已经完成交割手续", "尚未回复监管部门的问询函"]
    documents = {f"d{k}": "".join(rng.choice(words) + rng.choice(["。", "！！", "\n", "；", "\n\n", "\r\n \r\n", " "]) for _ in range(rng.choice([0, 6, 20, 120]))) for k in range(8)} | {"null": None}
    questions = [(run, f"q{k}", k) for run in ("r", "s") for k in range(6)]
    evidence = []
    for run, question, _ in questions:
        for p in range(rng.randrange(5)):
            d = rng.choice(list(documents) + ["unknown"])
            start = rng.randrange(-2, len(documents.get(d) or "") + 5)
            evidence.append((run, question, p, d, start, start + rng.choice([0, 3, 15, 40])))
    got = adversative.adversative_targets(
        spark.createDataFrame(questions, "run string, question_id string, position int"),
        spark.createDataFrame(evidence, "run string, question_id string, position int, document_id string, start int, end int"),
        spark.createDataFrame(list(documents.items()), "document_id string, text string"),
    ).collect()
    assert all(documents[r.document_id][r.start : r.end] == r.text for r in got)
    want = targets(questions, evidence, documents, ["反对", "异议", "尚未回复"])
    assert sorted((r.run, r.question_id, r["rank"], r.n_hits, r.place, r.document_id, r.start, r.matched) for r in got) == want and want


def test_adversative_scripts(spark):
    text = "無關的一句話在此。股東對此提出異議並要求補充。\n\n另一段也有異議但不在此處。"
    docs = spark.createDataFrame([("d", text), ("d", text)], "document_id string, text string")
    questions = spark.createDataFrame([("r", "q", 0)], "run string, question_id string, position int")
    evidence = spark.createDataFrame([("r", "q", 0, "d", 0, 5), ("r", "other", 0, "d", 0, 5)], "run string, question_id string, position int, document_id string, start int, end int")
    got = adversative.adversative_targets(questions, evidence, docs).orderBy("place").collect()
    assert [(r.text, r.matched) for r in got] == [("股東對此提出異議並要求補充。", True), ("無關的一句話在此。", False)]
