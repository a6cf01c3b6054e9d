"""JSON in the replies of models: fenced, bare, with stray commas, or cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLY = T.StructType([T.StructField("json", T.StringType()), T.StructField("salvaged", T.BooleanType()), T.StructField("reason", T.StringType())])

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
_STRAY_COMMA = re.compile(r",\s*(?=[}\]])")
#: A string (perhaps without its end), or a bracket.
_MARK = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[][{}]', re.DOTALL)
_CLOSES = {"[": "]", "{": "}"}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def _brackets(text: str) -> list[tuple[str, int]]:
    """Brackets outside strings with their places, from the first one on."""
    first = re.search(r"[\[{]", text)
    return [(m[0], m.start()) for m in _MARK.finditer(text, first.start())] if first else []


def balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it, counting brackets of its kind only."""
    marks = [(c, i) for c, i in _brackets(text) if c in "[]{}"]
    depth = 0
    for c, i in marks:
        depth += (c == marks[0][0]) - (c == _CLOSES[marks[0][0]])
        if depth == 0:
            return text[marks[0][1] : i + 1]
    return None


def closed(text: str) -> str | None:
    """What is complete of a reply that was cut off, with what is still open there closed; None if nothing is, or nothing is open."""
    open_: list[str] = []
    whole = None
    for c, i in _brackets(text):
        if c in _CLOSES:
            open_.append(_CLOSES[c])
        elif c in "]}":
            if open_:
                open_.pop()
            whole = (i + 1, list(open_))
    if whole is None or not whole[1]:
        return None
    return text[text.index(re.search(r"[\[{]", text)[0]) : whole[0]] + "".join(reversed(whole[1]))


def read_reply(text: str | None) -> tuple[str | None, bool, str | None]:
    """(json, salvaged, reason): the JSON text of a reply; `salvaged` says that its end was lost, `reason` that there is none."""
    text = text or ""
    fenced = _FENCE.search(text)
    candidates = [x.strip() for x in ([fenced[1]] if fenced else []) + [text]]
    for candidate in candidates:
        for source in (candidate, balanced(candidate)):
            for tried in (source, _STRAY_COMMA.sub("", source)) if source else ():
                if _is_json(tried):
                    return tried, False, None
    for candidate in candidates:
        whole = closed(candidate)
        if whole is not None and _is_json(whole):
            return whole, True, None
    return None, False, f"model reply was not JSON: {text[:300]}"


@F.pandas_udf(REPLY)
def _read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    # Spark has no parser that tells where a cut value is still whole.
    for texts in parts:
        yield pd.DataFrame([read_reply(t) for t in texts], columns=REPLY.names)


def reply(text: Column) -> Column:
    """(json, salvaged, reason) of a reply, for `from_json`; only complete elements of a cut reply are kept."""
    return _read(text)
