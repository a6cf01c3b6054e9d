"""Figures in texts, and what they are worth, as built-in Spark expressions.

A text is cut at its figures by one pattern that tries the kinds in their
order of precedence at each place; then each piece is read on its own.  Values
are decimals as strings without exponent or trailing zeros, of any length:
units are powers of ten, so a value is its figure with the point moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold_width, let

# Labels of amounts with their currency and power of ten, marks
# before amounts, scales, and the forms of dates, documents and shares.
LABELS = (
    "万亿元",
    "萬億元",
    "亿元",
    "億元",
    "万元",
    "萬元",
    "千元",
    "百万元",
    "百萬元",
    "元人民币",
    "元人民幣",
    "人民币",
    "人民幣",
    "元",
    "万港元",
    "萬港元",
    "港元",
    "万美元",
    "萬美元",
    "美元",
    "million yuan",
    "million rmb",
    "million cny",
    "million dollars",
    "million dollar",
    "billion yuan",
    "billion rmb",
    "billion cny",
    "billion dollars",
    "billion dollar",
    "yuan",
    "cny",
    "rmb",
    "usd",
    "hkd",
)
AMOUNTS = {
    "元": ("CNY", 0),
    "元人民币": ("CNY", 0),
    "人民币": ("CNY", 0),
    "万元": ("CNY", 4),
    "千元": ("CNY", 3),
    "百万元": ("CNY", 6),
    "亿元": ("CNY", 8),
    "万亿元": ("CNY", 12),
    "cny": ("CNY", 0),
    "yuan": ("CNY", 0),
    "rmb": ("CNY", 0),
    "million yuan": ("CNY", 6),
    "million rmb": ("CNY", 6),
    "million cny": ("CNY", 6),
    "billion yuan": ("CNY", 9),
    "billion rmb": ("CNY", 9),
    "billion cny": ("CNY", 9),
    "美元": ("USD", 0),
    "万美元": ("USD", 4),
    "usd": ("USD", 0),
    "million dollars": ("USD", 6),
    "million dollar": ("USD", 6),
    "billion dollars": ("USD", 9),
    "billion dollar": ("USD", 9),
    "港元": ("HKD", 0),
    "万港元": ("HKD", 4),
    "hkd": ("HKD", 0),
}
MARKS = {"$": "USD", "¥": "CNY", "￥": "CNY", "CNY": "CNY", "RMB": "CNY", "USD": "USD", "HKD": "HKD"}
SCALES = {"thousand": 3, "million": 6, "billion": 9}
DECLARED = ("万亿元", "亿元", "万元", "千元", "元")
TRADITIONAL_LABELS = ("萬億幣", "万亿币")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DOCUMENT = r"[（(]\s*\d{4}\s*[）)]\s*[^，。；;\n]{0,24}?\d+\s*[号號]"
CJK_DATE = r"(?<!\d)\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
ISO_DATE = r"(?<!\d)\d{4}[-/]\d{1,2}[-/]\d{1,2}(?!\d)"
PERCENT = r"(?:%|％|percent|百分[点點])"

_MONTH = "(?:" + "|".join(MONTHS) + ")"
_ENGLISH_DATE = rf"\b(?:{_MONTH}\s+\d{{1,2}}(?:\s*,\s*|\s+)\d{{4}}|\d{{1,2}}\s+{_MONTH}(?:\s*,\s*|\s+)\d{{4}})\b"
_DATE = f"(?:{CJK_DATE}|{ISO_DATE}|{_ENGLISH_DATE})"
_FIGURE = r"[-+]?\d[\d,]*(?:\.\d+)?"
_MARK = r"(?:[$¥￥]|CNY|RMB|USD|HKD)"
_LABEL = "(?:" + "|".join(x.replace(" ", r"\s+") for x in LABELS) + ")"
_SCALAR = r"(?<![\d.,])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*倍)?(?!\.?\d)"

#: Every figure of a text.  A sign right before a date, and a label that marks
#: the next figure, are left to what they belong to.
FIGURES = (
    "(?iU)"
    + "|".join(
        [
            DOCUMENT,
            rf"[-+](?={_DATE})",
            _DATE,
            rf"{_MARK}\s*(?!{_DATE}){_FIGURE}\s*(?:{'|'.join(SCALES)})?",
            rf"(?<![\d.]){_FIGURE}\s*{_LABEL}(?![a-zA-Z])(?<!(?:cny|rmb|usd|hkd)(?=\s{{0,9}}[-+]?\d))",
            rf"(?<![\d.]){_FIGURE}\s*{PERCENT}",
            _SCALAR,
        ]
    )
)
_UNIT_DECLARED = r"[单單]位[:：]\s*(?:人民[币幣])?\s*(万亿元|萬億元|亿元|億元|万元|萬元|千元|元)"


def _canonical(whole: Column, part: Column, negative: Column) -> Column:
    """A decimal from its digits before and after the point, without zeros at either end."""
    parts = F.struct(F.ltrim(whole, F.lit("0")).alias("head"), F.rtrim(part, F.lit("0")).alias("tail"), negative.alias("negative"))

    def number(p: Column) -> Column:
        sign = F.when(p["negative"] & ((p["head"] != "") | (p["tail"] != "")), "-").otherwise("")
        return F.concat(sign, F.when(p["head"] == "", "0").otherwise(p["head"]), F.when(p["tail"] == "", "").otherwise(F.concat(F.lit("."), p["tail"])))

    return let(parts, number)


def _digits(decimal: Column) -> Column:
    """The digits before and after the point, and whether there is a minus; of a text that is a decimal."""
    def parts(plain: Column) -> Column:
        return F.struct(F.substring_index(plain, ".", 1).alias("whole"), F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("").alias("part"), decimal.startswith("-").alias("negative"))

    return let(F.translate(decimal, ",+-", ""), parts)


def shift_point(decimal: Column, places: Column) -> Column:
    """A canonical decimal times ten to the power `places` (of either sign), exactly; null for anything else."""
    up, down = F.greatest(places, F.lit(0)), F.greatest(-places, F.lit(0))

    def padded(d: Column) -> Column:
        whole = F.greatest(F.length(d["whole"]), down + 1)
        digits = F.concat(F.lpad(d["whole"], whole, F.lit("0")), F.rpad(d["part"], F.greatest(F.length(d["part"]), up), F.lit("0")))
        return F.struct(digits.alias("digits"), (whole - down + up).alias("at"), d["negative"].alias("negative"))

    def cut(d: Column) -> Column:
        return _canonical(F.substr(d["digits"], F.lit(1), d["at"]), F.substr(d["digits"], d["at"] + 1), d["negative"])

    return F.when(decimal.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\z"), let(let(_digits(decimal), padded), cut))


def label_of(text: Column) -> Column:
    """A label of amounts in one form: lower case, single spaces, simplified characters."""
    return F.translate(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), *TRADITIONAL_LABELS)


def _choice(of: Column, choices: dict) -> Column:
    """The value of a choice, null for anything else."""
    held = F.create_map(*(F.lit(x) for pair in choices.items() for x in pair))
    return F.try_element_at(held, of)


def explode_numbers(texts: DataFrame, text_col: str) -> DataFrame:
    """The rows of `texts` without their text, once for each figure in it.

    Added are place (from 0), raw, kind (doc_no, date, amount, percent or
    scalar), value, unit (a currency, date, doc_no, percent, scalar, multiple)
    and, for amounts, numeric_raw and power.  A null text has none.
    """
    keys = [c for c in texts.columns if c != text_col]
    marked = F.regexp_replace(F.translate(text_col, "\x01\x02", "  "), FIGURES, "\x01$0\x02")
    pieces = F.transform(F.split(F.coalesce(marked, F.lit("")), "\x01"), lambda p: F.substring_index(p, "\x02", 1))
    rows = texts.select(*keys, F.posexplode(pieces).alias("place", "raw")).where("place > 0").withColumn("place", F.col("place") - 1)
    # Parts of what a figure says are columns of their own, so that each is found once.
    raw, plain = F.col("raw"), F.col("_plain")
    rows = rows.select(
        *keys,
        "place",
        "raw",
        fold_width(raw).alias("_plain"),
        F.upper(F.regexp_extract(raw, rf"(?i)^{_MARK}", 0)).alias("_mark"),
        raw.rlike(rf"(?iU)^{_DATE}$").alias("_is_date"),
    )
    # What stands after the last digit: a label, a scale, or neither.
    rows = rows.withColumn("_label", label_of(F.regexp_extract("_plain", r"[^0-9.,]*$", 0)))
    mark, label = F.col("_mark"), F.col("_label")
    kind = (
        F.when(raw.rlike(r"^[（(]"), "doc_no")
        .when(F.col("_is_date"), "date")
        .when((mark != "") | label.isin(*AMOUNTS), "amount")
        .when(raw.rlike(rf"(?iU){PERCENT}$"), "percent")
        .when(raw.rlike(r"(?U)\d"), "scalar")
    )
    currency = F.when(mark != "", _choice(mark, MARKS)).otherwise(_choice(label, {k: v for k, (v, _) in AMOUNTS.items()}))
    power = F.when(mark != "", _choice(label, SCALES)).otherwise(_choice(label, {k: v for k, (_, v) in AMOUNTS.items()}))
    printed = F.regexp_extract(plain, r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    figure = let(printed, lambda p: F.when(p != "", let(_digits(p), lambda d: _canonical(d["whole"], d["part"], d["negative"]))))
    rows = rows.select(
        *keys,
        "place",
        F.regexp_replace("raw", ",$", "").alias("raw"),
        kind.alias("kind"),
        F.when(~F.col("_is_date"), figure).alias("_figure"),
        F.when(F.col("_is_date"), F.regexp_extract_all(plain, F.lit(r"[0-9]+"), F.lit(0))).alias("_numbers"),
        F.when(F.col("_is_date"), F.lower(F.regexp_extract(raw, rf"(?i){_MONTH}", 0))).alias("_month"),
        F.when(raw.rlike(r"^[（(]"), normal_document(raw)).alias("_doc"),
        F.coalesce(power, F.lit(0)).alias("_power"),
        currency.alias("_currency"),
    )
    numbers, month = F.col("_numbers"), F.array_position(F.array(*map(F.lit, MONTHS)), F.col("_month"))
    year_first = F.length(F.get(numbers, F.lit(0))) == 4
    date = F.concat_ws(
        "-",
        F.lpad(F.when(year_first, F.get(numbers, F.lit(0))).otherwise(F.get(numbers, F.lit(1))), 4, "0"),
        F.lpad(F.when(month > 0, month.cast("string")).otherwise(F.get(numbers, F.lit(1))), 2, "0"),
        F.lpad(F.when(year_first, F.get(numbers, F.lit(2))).otherwise(F.get(numbers, F.lit(0))), 2, "0"),
    )
    rows = rows.select(*keys, "place", "raw", "kind", "_figure", date.alias("_date"), "_doc", "_power", "_currency")
    amount = F.col("kind") == "amount"
    value = F.when(amount, shift_point(F.col("_figure"), F.col("_power"))).when(F.col("kind") == "date", F.col("_date")).when(F.col("kind") == "doc_no", F.col("_doc")).otherwise(F.col("_figure"))
    unit = F.when(amount, F.col("_currency")).when((F.col("kind") == "scalar") & F.col("raw").contains("倍"), "multiple").otherwise(F.col("kind"))
    rows = rows.select(*keys, "place", "raw", "kind", value.alias("value"), unit.alias("unit"), F.when(amount, F.col("_figure")).alias("numeric_raw"), F.when(amount, F.col("_power")).alias("power"))
    # What is no figure is left out by exploding: a filter would be moved down, with all that it asks about computed again for it.
    read = F.struct("place", "raw", "kind", "value", "unit", "numeric_raw", "power")
    known = F.when(F.col("kind").isNotNull() & F.col("value").isNotNull() & F.col("unit").isNotNull(), F.array(read))
    return rows.select(*keys, F.explode(known).alias("_read")).select(*keys, "_read.*")


def normal_document(text: Column) -> Column:
    """A document number without white space, in half width and lower case."""
    return F.lower(fold_width(F.regexp_replace(text, r"(?U)\s+", "")))


def declared_units(texts: DataFrame, text_col: str) -> DataFrame:
    """The rows of `texts` without their text, once for each distinct unit (unit, power) that it declares for its tables."""
    keys = [c for c in texts.columns if c != text_col]
    labels = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"(?U){_UNIT_DECLARED}"), F.lit(1)), label_of))
    rows = texts.select(*keys, F.explode(labels).alias("label"))
    known = {k: v for k, v in AMOUNTS.items() if k in DECLARED}
    return rows.select(*keys, _choice(F.col("label"), {k: v for k, (v, _) in known.items()}).alias("unit"), _choice(F.col("label"), {k: v for k, (_, v) in known.items()}).alias("power"))
