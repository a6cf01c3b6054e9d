"""Unicode normalisation, and folding of scripts by a table that is given."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .text import let

#: Characters to replace and what they become, one for one; None leaves texts as they are.
Script = tuple[str, str] | None

#: Traditional forms of the characters that the fixed patterns of this library
#: use, and their simplified ones: enough to fold a text for those patterns,
#: not for comparing texts, which takes a whole table (`script_of`).
PATTERN_SCRIPT = (
    "萬億號幣單價發額總餘資對規數時間書點個節標說際兩還話長佔幾業證",
    "万亿号币单价发额总余资对规数时间书点个节标说际两还话长占几业证",
)


@F.pandas_udf(StringType())
def _nfkc_casefold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    # Spark has no expression for compatibility forms.
    for texts in parts:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column, script: Script = None) -> Column:
    """Compatibility forms and case folded away, then characters of `script` replaced one by one."""
    out = _nfkc_casefold(text)
    return F.translate(out, *script) if script else out


def normal_text(text: Column, script: Script = None) -> Column:
    """`folded`, and nothing left but word characters and CJK."""
    return F.regexp_replace(folded(text, script), r"[^\p{L}\p{N}_\x{3400}-\x{9fff}]+", "")


def script_of(variants: DataFrame) -> tuple[str, str]:
    """Two equally long texts for `folded` from rows (traditional, simplified) of single characters.

    A character with several simplified forms, or itself a simplified form, is
    left out, so that folding is one to one.  The table is bounded by the
    number of characters.
    """
    rows = variants.where("length(traditional) = 1 and length(simplified) = 1 and traditional <> simplified").distinct()
    single = rows.groupBy("traditional").agg(F.count("*").alias("n"), F.first("simplified").alias("simplified")).where("n = 1")
    single = single.join(rows.select(F.col("simplified").alias("traditional")).distinct(), "traditional", "left_anti")
    pairs = sorted((r.traditional, r.simplified) for r in single.collect())
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(traditional, simplified) from a file of lines `U+XXXX<tab>kSimplifiedVariant<tab>U+YYYY`, the form of Unicode's tables."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p")).where(F.get("p", F.lit(1)) == "kSimplifiedVariant")

    def character(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.regexp_replace(code, r"^U\+", ""), 8, "0")), "UTF-32BE")

    forms = F.explode(F.regexp_extract_all(F.get("p", F.lit(2)), F.lit(r"U\+[0-9A-F]+"), F.lit(0)))
    return rows.select(F.get("p", F.lit(0)).alias("t"), forms.alias("s")).select(character(F.col("t")).alias("traditional"), character(F.col("s")).alias("simplified"))


def scoring_units(text: Column, script: Script = None) -> Column:
    """Distinct units of a folded text: words, figures as they are written, and character pairs of CJK runs."""

    def units(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(r"[a-z]+(?:'[a-z]+)?|[-+]?(?U:\d)(?U:[\d,.%/-])*"), F.lit(0))
        pairs = F.regexp_extract_all(t, F.lit(r"(?=([\x{3400}-\x{9fff}]{2}))"), F.lit(1))
        single = F.regexp_extract_all(t, F.lit(r"(?<![\x{3400}-\x{9fff}])([\x{3400}-\x{9fff}])(?![\x{3400}-\x{9fff}])"), F.lit(1))
        return F.array_distinct(F.concat(words, pairs, single))

    return let(folded(F.coalesce(text, F.lit("")), script), units)


@F.pandas_udf(LongType())
def _longest_common(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest substring that both texts have; null for nulls."""

    def longest(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        row, best = np.zeros(len(b) + 1, dtype=np.int64), 0
        held = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
        for c in np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32):
            row[1:] = np.where(held == c, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best

    for a, b in parts:
        yield pd.Series([longest(x, y) for x, y in zip(a, b)], dtype="Int64")


def overlap(reference: Column, candidate: Column) -> Column:
    """How much of a normal reference a normal candidate holds: 1 if all, else by the longest part that both have.

    Empty texts overlap nothing, and those of fewer than 4 characters only
    their equals.
    """
    ref, cand = F.coalesce(reference, F.lit("")), F.coalesce(candidate, F.lit(""))
    short = F.least(F.length(ref), F.length(cand)) < 4
    simple = (
        F.when((ref == "") | (cand == ""), 0.0)
        .when(short, (ref == cand).cast("double"))
        .when(cand.contains(ref), 1.0)
        .when(ref.contains(cand), F.length(cand) / F.length(ref))
    )
    # The helper sees only pairs that no expression settles.
    left, right = (F.when(simple.isNull(), x) for x in (ref, cand))
    return F.coalesce(simple, _longest_common(left, right) / F.length(ref))
