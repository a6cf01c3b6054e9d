"""Figures as the verifier reads them: found in a copy in one width and script, reported with the original's offsets.

The scorer's reading (`numbers.py`) and this one differ on purpose: a check
must not share its reading with what it checks.  Here a form that comes first
in FORMS takes its characters, and a later one that touches them is dropped
whole, which no single pattern expresses; so texts with a digit go to a small
Python helper in Arrow batches, and everything after it is expressions.
Offsets are code points.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from math import gcd

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import PATTERN_SCRIPT

# Units of amounts with currency and multiplier, currencies and
# scales around figures, months, and where a heading's scope ends.
UNITS = (
    ("万亿元", "CNY", 1_000_000_000_000),
    ("百万元", "CNY", 1_000_000),
    ("亿元", "CNY", 100_000_000),
    ("万元", "CNY", 10_000),
    ("千元", "CNY", 1_000),
    ("元人民币", "CNY", 1),
    ("人民币", "CNY", 1),
    ("元", "CNY", 1),
    ("万港元", "HKD", 10_000),
    ("亿港元", "HKD", 100_000_000),
    ("港元", "HKD", 1),
    ("万美元", "USD", 10_000),
    ("亿美元", "USD", 100_000_000),
    ("美元", "USD", 1),
    ("billion yuan", "CNY", 1_000_000_000),
    ("million yuan", "CNY", 1_000_000),
    ("billion rmb", "CNY", 1_000_000_000),
    ("million rmb", "CNY", 1_000_000),
    ("billion dollars", "USD", 1_000_000_000),
    ("million dollars", "USD", 1_000_000),
    ("billion dollar", "USD", 1_000_000_000),
    ("million dollar", "USD", 1_000_000),
    ("cny", "CNY", 1),
    ("rmb", "CNY", 1),
    ("usd", "USD", 1),
    ("hkd", "HKD", 1),
    ("yuan", "CNY", 1),
    ("renminbi", "CNY", 1),
    ("hong kong dollars", "HKD", 1),
    ("hong kong dollar", "HKD", 1),
    ("us dollars", "USD", 1),
    ("us dollar", "USD", 1),
    ("dollars", "USD", 1),
    ("dollar", "USD", 1),
)
CODES_BEFORE = {"cny": "CNY", "rmb": "CNY", "usd": "USD", "hkd": "HKD", "us$": "USD", "hk$": "HKD"}
SIGNS_BEFORE = {"$": "USD", "¥": "CNY", "￥": "CNY"}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WIDE, NARROW = "０１２３４５６７８９．，％－＋（）", "0123456789.,%-+()"
DECLARATION = r"(?:单位|單位)\s*[:：]\s*(?:人民币|人民幣|港币|港幣|美元)?\s*(万亿元|百万元|亿元|万元|千元|元|万港元|亿港元|港元|万美元|亿美元|美元)"
ENGLISH_DECLARATION = r"(?<![A-Za-z0-9_])in\s+(thousands|millions|billions)(?![A-Za-z0-9_])(?:\s+of\s+(dollars|usd|rmb|yuan|cny)(?![A-Za-z0-9_]))?"
PERCENT_HEADING = r"\(\s*%\s*\)"
TRANSITION = r"第[一二三四五六七八九十0-9]+节|(?<![0-9.])[1-9][0-9]*\.[0-9][ \t]+[㐀-鿿a-z]|(?:反映|上述)[^。\n]{0,40}(?:指标|说明)|(?:单位|單位)\s*[:：]"
SCOPE = 1_600
_CLOSINGS = re.compile(DECLARATION), re.compile(TRANSITION, re.IGNORECASE)
_SCALE = re.compile("thousands|millions|billions", re.IGNORECASE)

_NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
_SCALED = "|".join(reversed(SCALES))
_WORD = "[A-Za-z0-9_]"

#: Forms in the order in which they take characters; with signs, a text has one of them or nothing in this form.
FORMS = [
    (kind, re.compile(pattern, re.IGNORECASE), signs)
    for kind, pattern, *signs in (
        ("doc_no", r"[（(]\s*[0-9]{4}\s*[）)]\s*[^，。；;\n]{0,24}?[0-9]+\s*号", "号"),
        ("date", r"(?<![0-9])(?P<y>[0-9]{4})\s*年\s*(?P<m>[0-9]{1,2})\s*月\s*(?P<d>[0-9]{1,2})\s*日", "年"),
        ("date", r"(?<![0-9])(?P<y>[0-9]{4})[-/](?P<m>[0-9]{1,2})[-/](?P<d>[0-9]{1,2})(?![0-9])", "-", "/"),
        ("date", rf"(?<!{_WORD})(?P<m>{'|'.join(MONTHS)})\s+(?P<d>[0-9]{{1,2}}),?\s+(?P<y>[0-9]{{4}})(?!{_WORD})"),
        ("date", rf"(?<!{_WORD})(?P<d>[0-9]{{1,2}})\s+(?P<m>{'|'.join(MONTHS)})\s+(?P<y>[0-9]{{4}})(?!{_WORD})"),
        ("amount", rf"(?<!{_WORD})(?P<before>{'|'.join(map(re.escape, CODES_BEFORE))})\s*(?P<n>{_NUMBER})(?:\s*(?P<scale>{_SCALED}))?(?!{_WORD})"),
        ("amount", rf"(?P<before>[$¥￥])\s*(?P<n>{_NUMBER})(?:\s*(?P<scale>{_SCALED}))?", "$", "¥", "￥"),
        ("amount", rf"(?<![0-9.])(?P<n>{_NUMBER})\s*(?P<each>元|人民币|港元|美元)\s*/\s*(?:股|份)", "/"),
        ("amount", rf"(?<![0-9.])(?P<n>{_NUMBER})\s*(?P<label>{'|'.join(u.replace(' ', chr(92) + 's+') for u, _, _ in UNITS)})(?![a-zA-Z])"),
        ("percent", rf"(?<![A-Za-z0-9_.])(?P<n>{_NUMBER})\s*(?:%|％|percent|百分点)", "%", "％", "percent", "百分点"),
        ("scalar", rf"(?<![0-9.])(?P<n>{_NUMBER})(?P<times>\s*倍)?(?!\.?[0-9])"),
    )
]
_LABELS = {u: (currency, times) for u, currency, times in UNITS}

FIGURE = "struct<raw:string,kind:string,value:string,unit:string,numeric_raw:string,multiplier:string,start:int,end:int>"
HINT = "struct<unit:string,multiplier:string,source:string,start:int,end:int,figures:array<string>>"


def decimal_text(x: Fraction) -> str:
    """A number with finitely many decimals, without exponent or trailing zeros."""
    rest, places = x.denominator, 0
    while rest > 1:
        rest, places = rest // gcd(rest, 10), places + 1
    return _moved(("-" if x < 0 else "") + str(abs(x.numerator) * 10**places // x.denominator), -places)


def _moved(printed: str, places: int) -> str:
    """A printed decimal times ten to the power `places`, without trailing zeros."""
    whole, _, part = printed.lstrip("+-").replace(",", "").partition(".")
    digits, at = whole + part, len(whole) + places
    digits, at = digits.zfill(len(digits) - at) if at < 0 else digits.ljust(at, "0"), max(at, 0)
    head, tail = digits[:at].lstrip("0"), digits[at:].rstrip("0")
    return ("-" if printed.startswith("-") and (head or tail) else "") + (head or "0") + ("." + tail if tail else "")


@functools.cache
def _table(one: str, other: str) -> tuple[re.Pattern, dict[int, int]]:
    return re.compile(f"[{re.escape(one)}]" if one else "(?!)"), str.maketrans(one, other)


def translated(text: str, one: str, other: str) -> str:
    """The text with characters of `one` replaced by those of `other`; most have none, which is told faster."""
    held, table = _table(one, other)
    return text.translate(table) if held.search(text) else text


def _plain(text: str, script: tuple[str, str]) -> str:
    return translated(text, script[0] + WIDE, script[1] + NARROW)


def _read(kind: str, found: re.Match) -> tuple[str, str, str, str | None, str | None] | None:
    """kind, value, unit, figure before its multiplier, and multiplier of what a form found."""
    parts = found.groupdict()
    if kind == "doc_no":
        return kind, re.sub(r"\s+", "", unicodedata.normalize("NFKC", found[0])).lower(), kind, None, None
    if kind == "date":
        named = parts["m"].lower() in MONTHS
        month = MONTHS.index(parts["m"].lower()) + 1 if named else int(parts["m"])
        if named and not 1 <= int(parts["d"]) <= 31:
            return None
        return kind, f"{int(parts['y']):04d}-{month:02d}-{int(parts['d']):02d}", kind, None, None
    if kind != "amount":
        unit = "multiple" if parts.get("times") else kind
        return unit, _moved(parts["n"], 0), unit, None, None
    if parts.get("each"):
        currency, times = f"{_LABELS[parts['each']][0]}/unit", 1
    elif parts.get("label"):
        currency, times = _LABELS[re.sub(r"\s+", " ", parts["label"]).lower()]
    else:
        before = parts["before"].lower()
        currency, times = CODES_BEFORE.get(before) or SIGNS_BEFORE[before], SCALES.get((parts["scale"] or "").lower(), 1)
    # Multipliers are powers of ten.
    return kind, _moved(parts["n"], len(str(times)) - 1), currency, _moved(parts["n"], 0), str(times)


def figures_of(text: str, script: tuple[str, str] = PATTERN_SCRIPT) -> list[dict]:
    """The figures of a text in its order."""
    plain = _plain(text, script)
    taken, out, low = bytearray(len(plain)), [], plain.lower()
    for kind, form, signs in FORMS:
        if signs and not any(s in low for s in signs):
            continue
        for found in form.finditer(plain):
            start, end = found.span()
            read = _read(kind, found)
            if read is None or any(taken[start:end]):
                continue
            taken[start:end] = b"\x01" * (end - start)
            names = ("kind", "value", "unit", "numeric_raw", "multiplier")
            out.append({"raw": text[start:end], **dict(zip(names, read)), "start": start, "end": end})
    return sorted(out, key=lambda f: f["start"])


def unit_hints_of(text: str, script: tuple[str, str] = PATTERN_SCRIPT) -> list[dict]:
    """Units that a text declares for figures printed bare: for all of it, or for what is under a `(%)` heading.

    A heading's scope ends after SCOPE characters, at the next heading, at a
    declared unit, or where another table or section begins.
    """
    out: dict[tuple, dict] = {}

    def put(unit: str, multiplier: int, source: str, start: int | None = None, end: int | None = None, figures: list[str] | None = None) -> None:
        out.setdefault((unit, multiplier, start, end), {"unit": unit, "multiplier": str(multiplier), "source": source, "start": start, "end": end, "figures": figures})

    for m in re.finditer(DECLARATION, translated(text, *script)):
        put(*_LABELS[m[1]], re.sub(r"\s+", "", m[0]))
    # Most texts declare nothing in English.
    for m in re.finditer(ENGLISH_DECLARATION, text, re.IGNORECASE) if _SCALE.search(text) else ():
        chinese = (m[2] or "").lower() in ("rmb", "yuan", "cny")
        put("CNY" if chinese else "USD", SCALES[m[1].lower()[:-1]], m[0])
    plain = _plain(text, script)
    headings = list(re.finditer(PERCENT_HEADING, plain))
    for m, after in zip(headings, [*headings[1:], None]):
        end = min(len(plain), m.start() + SCOPE, after.start() if after else len(plain))
        for closing in _CLOSINGS:
            found = closing.search(plain[m.end() : end])
            if found:
                end = m.end() + found.start()
        bare = [f["value"] for f in figures_of(text[m.start() : end], script) if f["kind"] == "scalar"]
        put("percent", 1, text[m.start() : m.end()], m.start(), end, list(dict.fromkeys(bare)))
    return list(out.values())


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _helper(of, script: tuple[str, str], kind: str):
    fields = (f.split(":") for f in kind.removeprefix("struct<")[:-1].split(","))
    made = pa.list_(pa.struct([(name, _ARROW[of_type]) for name, of_type in fields]))

    # Nested rows as Arrow arrays; measured, they take as long as by way of pandas.
    @F.arrow_udf(f"array<{kind}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([[] if t is None else of(t, script) for t in texts.to_pylist()], type=made)

    return run


def figures(text: Column, script: tuple[str, str] = PATTERN_SCRIPT) -> Column:
    """The figures of a text as an array of FIGURE; of texts without a digit, and null ones, none."""
    found = _helper(figures_of, script, FIGURE)(F.when(text.rlike("[0-9０-９]"), text))
    return F.coalesce(found, F.array().cast(f"array<{FIGURE}>"))


def unit_hints(text: Column, script: tuple[str, str] = PATTERN_SCRIPT) -> Column:
    """The units that a text declares as an array of HINT; offsets and figures only of `(%)` headings."""
    asked = text.rlike(r"(?i)单位|單位|in\s+(?:thousand|million|billion)|[%％]")
    found = _helper(unit_hints_of, script, HINT)(F.when(asked, text))
    return F.coalesce(found, F.array().cast(f"array<{HINT}>"))
