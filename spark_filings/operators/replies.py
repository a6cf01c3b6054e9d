"""Stored replies of models as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import reply


def parse_replies(replies: DataFrame, reply_col: str, element: str, path: str = "items") -> DataFrame:
    """The columns of `replies` without the reply, once for each element of its array: place (from 0), element, salvaged and reason.

    A reply is an array, or an object with one under `path`; `element` is the
    schema of its elements (DDL).  A reply may be fenced or bare, may have
    stray commas, and may be cut off: then the elements that are complete are
    kept and salvaged is true.  One without JSON is a row with its reason and
    null place and element; one whose array is empty, or that has none, has
    neither element nor reason.
    """
    keys = [c for c in replies.columns if c != reply_col]
    rows = replies.select(*keys, reply(F.col(reply_col)).alias("_r"))
    text = F.col("_r.json")
    listed = F.when(F.ltrim(text).startswith("["), text).otherwise(F.get_json_object(text, f"$.{path}"))
    rows = rows.select(*keys, F.posexplode_outer(F.from_json(listed, f"array<{element}>")).alias("place", "element"), F.col("_r.salvaged").alias("salvaged"), F.col("_r.reason").alias("reason"))
    return rows
