"""Where patterns match in texts, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_marks(text: Column) -> Column:
    """The text without the control characters that `places` sets; call it on what is searched."""
    return F.translate(text, "\x01\x02\x03", "   ")


def places(text: Column, pattern: Column | str, **fixed: str) -> Column:
    """Matches of a pattern as an array of (before, match, and the fixed fields): the text up to it, and what matched."""
    parts = F.split(F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), "\x01$0\x02"), "\x01")

    def place(i: Column) -> Column:
        return F.struct(
            F.translate(F.array_join(F.slice(parts, F.lit(1), i), ""), "\x02", "").alias("before"),
            F.substring_index(F.get(parts, i), "\x02", 1).alias("match"),
            *(F.lit(v).alias(k) for k, v in fixed.items()),
        )

    ddl = "array<struct<before:string,match:string" + "".join(f",{k}:string" for k in fixed) + ">>"
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), place)).otherwise(F.array().cast(ddl))
