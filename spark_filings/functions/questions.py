"""What questions ask for, what answers state or deny, and in which language: built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import PATTERN_SCRIPT
from .text import fold_width, let

# Characters and words by language and kind.
CJK = r"[\x{3400}-\x{9fff}]"
TRADITIONAL_SIGNS = "繁體臺灣證券報導債務關於財務營業盈餘"
ABSENCE = {
    "zh-CN": r"未披露|未提及|未指定|未确定|未明确|未说明|尚未|暂未|暂无|尚无|无法核实|没有披露",
    "zh-TW": r"未揭露|未披露|未提及|未指定|未確定|未明確|未說明|尚未|暫未|暫無|尚無|無法核實|沒有揭露",
    "en": r"(?i)\b(?:not disclosed|does not disclose|not stated|not specified|not yet|cannot be verified|no such|undetermined)\b",
}
UNVERIFIABLE = {
    "zh-CN": ("无法核实", "来源未披露", "公告未披露", "原文未提及"),
    "zh-TW": ("無法核實", "來源未披露", "公告未披露", "原文未提及"),
    "en": ("cannot be verified", "not disclosed", "the source does not state"),
}
ASKED = {
    "price": r"(?i)每股|单价|價格|价格|发行价|發行價|price per share|unit price|issue price",
    "amount": r"(?i)金额|金額|总额|總額|余额|餘額|募集资金|募集資金|对价|對價|代价|规模|規模|amount|proceeds|consideration|value|cost",
    "count": r"(?i)多少股|股数|股數|数量|數量|份额|份額|number of shares|how many shares|quantity|volume",
    "percent": r"(?i)比例|占比|佔比|百分|幅度|增速|利率|percentage|share of|ratio|proportion",
    "date": r"(?i)何时|何時|哪一天|日期|时间安排|時間安排|when|which date|what date",
    "doc_no": r"(?i)文号|案号|哪一份.*(?:文书|文書)|which legal document|case number|document number",
}
REMAINING = r"(?i)还可|還可|剩余|剩餘|尚余|尚餘|尚可|余额还|remaining|(?:how much|amount).*(?:left|remains)|still available"
NUMERALS = "〇零一二兩两三四五六七八九十百千万萬亿億"
COUNTING = "〇零一二兩两三四五六七八九十"
COUNTED = rf"百分之[{NUMERALS}]+|[{COUNTING}](?:元|万元|萬元|亿元|億元|股|%|％|成|折|倍|个百分点|個百分點)"
NUMBER_WORDS = (
    r"(?i)\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|percent)\b"
)


def infer_lang(text: Column) -> Column:
    """en without CJK, else zh-TW with a character that only traditional texts have, else zh-CN."""
    return F.when(~text.rlike(CJK), "en").when(text.rlike(f"[{TRADITIONAL_SIGNS}]"), "zh-TW").otherwise("zh-CN")


def count_of(text: Column, characters: str) -> Column:
    """How many of some characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def matches_script(text: Column, lang: Column, script: tuple[str, str], least: int = 8) -> Column:
    """Whether a text is in the script of its language, by the characters of `script` (traditional, simplified); with few of them it is."""
    traditional, simplified = (count_of(text, x) for x in script)
    own = F.when(lang == "zh-TW", traditional).otherwise(simplified)
    return (lang == "en") | (traditional + simplified < least) | (own / (traditional + simplified) >= 0.5)


def _by_lang(lang: Column, of) -> Column:
    return reduce(lambda out, k: out.when(lang == k, of(k)), ("zh-TW", "en"), F.when(lang == "zh-CN", of("zh-CN")))


def reads_as_absence(text: Column, lang: Column) -> Column:
    """Whether a text answers by saying that nothing was disclosed, however it is put."""
    return _by_lang(lang, lambda k: text.rlike(ABSENCE[k]))


def states_unverifiable(text: Column, lang: Column) -> Column:
    """Whether a text has one of the fixed statements that the sources do not answer."""
    return _by_lang(lang, lambda k: reduce(lambda a, b: a | b, (F.lower(text).contains(m) for m in UNVERIFIABLE[k])))


def asked_kinds(question: Column, script: tuple[str, str] = PATTERN_SCRIPT) -> Column:
    """The kinds of figures that a question asks for, in either script, in the order of ASKED."""
    return let(F.translate(question, *script), lambda q: F.array_compact(F.array(*(F.when(q.rlike(p), F.lit(k)) for k, p in ASKED.items()))))


def asks_remaining(question: Column, script: tuple[str, str] = PATTERN_SCRIPT) -> Column:
    """Whether a question asks, in either script, for what is left of an amount."""
    return F.translate(question, *script).rlike(REMAINING)


def written_numerals(text: Column) -> Column:
    """Every numeral of a text: in digits, in Chinese numerals, and in English words (lower case)."""
    plain = fold_width(text)
    compact = F.regexp_replace(plain, r"(?U)\s+", "")

    def found(of: Column, pattern: str) -> Column:
        return F.regexp_extract_all(of, F.lit(pattern), F.lit(0))

    return F.concat(found(plain, r"[0-9][0-9,.]*"), found(compact, f"[{NUMERALS}]{{2,}}"), found(compact, COUNTED), found(F.lower(plain), NUMBER_WORDS))


def substitute_derivation(text: Column, name: Column, display: Column) -> Column:
    """`{{name}}` replaced by `display`; a unit that follows and repeats its own goes."""
    unit = F.regexp_extract(F.trim(display), r"[^\d\s.,%]+$", 0)
    holder = F.concat(F.lit(r"\Q{{"), name, F.lit(r"}}\E"))
    pattern = F.when(unit == "", holder).otherwise(F.concat(holder, F.lit(r"[ \x{3000}]*(?:\Q"), unit, F.lit(r"\E)?")))
    return F.regexp_replace(text, pattern, F.regexp_replace(display, r"([\\$])", r"\\$1"))
