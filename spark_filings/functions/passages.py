"""Passages of a text with their places, and where quotes of it are.

Helpers work on one document at a time, which its quotes share; offsets are
code points of the document as it is.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .figures import figures_of, translated
from .text import TERMINATORS

# White space that quotes may differ in, the longest span that is
# built, and how often it is extended for figures.
BLANK = r"\s​﻿"
LONGEST_SPAN = 240
EXTENSIONS = 4

_PASSAGE = re.compile(rf"[^{TERMINATORS}\n]*(?:[{TERMINATORS}\n]+|$)")
_OPEN = re.compile(rf"[^{TERMINATORS}]\Z")

PASSAGE = "struct<text:string,start:int,end:int>"


def passages_of(text: str) -> list[tuple[str, int, int]]:
    """(passage, start, end): cut after each run of terminators and line ends, trimmed, blanks dropped; slices of the text."""
    out = []
    for m in _PASSAGE.finditer(text):
        kept = m[0].strip()
        if kept:
            start = m.start() + m[0].index(kept)
            out.append((kept, start, start + len(kept)))
    return out


def passages_at(text: Column) -> Column:
    """The passages of a text as an array of PASSAGE; null has none."""

    @F.pandas_udf(f"array<{PASSAGE}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: [{"text": p, "start": s, "end": e} for p, s, e in passages_of(t or "")])

    return run(text)


_BLANK_LINE = re.compile(r"\r?\n[\t ]*\r?\n")
_SENTENCE = re.compile(rf"(?:[^{TERMINATORS}\r\n]|\r(?!\n))*(?:[{TERMINATORS}]+|\r?\n|$)")

SENTENCE = "struct<paragraph:int,region_start:int,region_end:int,start:int,end:int,text:string>"


def sentences_of(text: str) -> list[dict]:
    """The sentences of each paragraph, trimmed, as slices of the text.

    Blank lines part paragraphs; a paragraph's region begins with the blank
    line before it, so that every place is in one.
    """
    out, cuts = [], [(0, 0), *(m.span() for m in _BLANK_LINE.finditer(text)), (len(text), len(text))]
    for number, ((begin, inner), (end, _)) in enumerate(zip(cuts, cuts[1:])):
        for m in _SENTENCE.finditer(text, inner, end):
            kept = m[0].strip()
            if kept:
                start = m.start() + m[0].index(kept)
                out.append({"paragraph": number, "region_start": begin, "region_end": end, "start": start, "end": start + len(kept), "text": kept})
    return out


def sentences_at(text: Column) -> Column:
    """The sentences of a text as an array of SENTENCE; null has none."""

    @F.pandas_udf(f"array<{SENTENCE}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: sentences_of(t or ""))

    return run(text)


def _units(text: str) -> set[str]:
    out = set(re.findall(r"[a-z]+(?:'[a-z]+)?|[-+]?[0-9][0-9,.%/-]*", text))
    for run in re.findall("[㐀-鿿]+", text):
        out |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
    return out


class Document:
    """A text whose reduced forms and passages are made once, when they are needed."""

    def __init__(self, text: str, script: tuple[str, str]) -> None:
        self.text, self._script = text, script

    def fold(self, text: str) -> str:
        return translated(text, *self._script)

    @functools.cached_property
    def folded(self) -> str:
        return self.fold(self.text)

    @functools.cached_property
    def bare(self) -> str:
        """The folded text without white space."""
        return re.sub(f"[{BLANK}]+", "", self.folded)

    @functools.cached_property
    def places(self) -> list[int]:
        """Where each character of the bare text is."""
        return [i for m in re.finditer(f"[^{BLANK}]+", self.folded) for i in range(*m.span())]

    @functools.cached_property
    def passages(self) -> list[tuple[str, int, int]]:
        return passages_of(self.text)

    def locate(self, quote: str) -> tuple[int, int, bool] | None:
        """(start, end, exact) of the first place of a quote: as it is, in the other script, or with other white space."""
        quote = quote.strip()
        if not quote:
            return None
        at = self.text.find(quote)
        if at >= 0:
            return at, at + len(quote), True
        at = self.folded.find(self.fold(quote))
        if at >= 0:
            return at, at + len(quote), False
        needle = re.sub(f"[{BLANK}]+", "", self.fold(quote))
        at = self.bare.find(needle) if needle else -1
        return (self.places[at], self.places[at + len(needle) - 1] + 1, False) if at >= 0 else None

    def occurrences(self, quote: str) -> list[tuple[int, int]]:
        """All exact places of a quote, overlapping ones too; else the one that `locate` finds."""
        quote = quote.strip()
        found, at = [], self.text.find(quote) if quote else -1
        while at >= 0:
            found.append((at, at + len(quote)))
            at = self.text.find(quote, at + 1)
        if not found and (other := self.locate(quote)):
            found = [other[:2]]
        return found

    def missing(self, figures: list[str], start: int, end: int) -> list[str]:
        held = self.folded[start:end]
        return [f for f in figures if self.fold(f) not in held]

    def widened(self, start: int, end: int, figures: list[str]) -> dict:
        """Whole passages around a place, extended over neighbours that have figures still missing, and over open line ends."""
        p = self.passages
        first = next((i for i, x in enumerate(p) if x[2] > start), 0)
        last = next((i for i, x in enumerate(p) if x[2] >= end), len(p) - 1)
        reached = joined = False

        def helps(i: int) -> bool:
            return 0 <= i < len(p) and len(self.missing(gone, *p[i][1:])) < len(gone)

        for _ in range(EXTENSIONS):
            gone = self.missing(figures, p[first][1], p[last][2])
            if not gone:
                break
            if helps(last + 1) and p[last + 1][2] - p[first][1] <= LONGEST_SPAN:
                last += 1
            elif helps(first - 1) and p[last][2] - p[first - 1][1] <= LONGEST_SPAN:
                first -= 1
            else:
                break
            reached = True
        while last + 1 < len(p) and _OPEN.search(p[last][0]) and p[last + 1][2] - p[first][1] <= LONGEST_SPAN:
            last, joined = last + 1, True
        start, end = p[first][1], p[last][2]
        return {"start": start, "end": end, "figures": len(figures) - len(self.missing(figures, start, end)), "reached": reached, "joined": joined}

    def choose(self, quote: str, claim: str) -> dict | None:
        """The span that a claim cites: most of its figures, then most of its wording, then the shortest and the first."""
        found = self.occurrences(quote)
        if not found or not self.passages:
            return None
        figures = [f["raw"].strip() for f in figures_of(claim) if f["kind"] != "date" or re.search("[0-9]{4}", f["raw"])]
        wanted = self._said(claim)
        best = None
        for place in found:
            span = self.widened(*place, figures)
            said = self._said(self.text[span["start"] : span["end"]])
            overlap = len(wanted & said) / len(wanted) if wanted else 1.0
            rank = (-span["figures"], -overlap, span["end"] - span["start"], span["start"])
            if best is None or rank < best[0]:
                best = rank, span, overlap
        _, span, overlap = best
        text = self.text[span["start"] : span["end"]]
        path = [f"occurrences={len(found)}", f"figures={span['figures']}/{len(figures)}", f"overlap={overlap:.2f}", f"chars={len(text)}", "extended-to-figure" if span["reached"] else "sentence-aligned"]
        return {"start": span["start"], "end": span["end"], "span": text, "path": " ".join(path + ["extended-open-boundary"] * span["joined"]), "adjusted": text != quote.strip()}

    def _said(self, text: str) -> set[str]:
        return _units(self.fold(unicodedata.normalize("NFKC", text).lower()))
