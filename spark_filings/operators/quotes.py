"""Quotes found in documents, the spans that claims cite, and claims whose quotes are lost."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.figures import translated
from ..functions.grams import code_points, gram_hashes
from ..functions.normal import PATTERN_SCRIPT
from ..functions.passages import BLANK, Document
from .lineage import saved

#: Quotes of one document that are searched together; more are dealt over copies of its text.
TOGETHER = 5_000

#: Quotes are looked for in other documents of their run by grams of so many
#: characters, the least of so many neighbours; shorter ones in all of them.
GRAM, NEIGHBOURS = 8, 8
SHORT = GRAM + NEIGHBOURS - 1

#: Grams that are sent to every task at most.
MOST_GRAMS = 1_000_000

_FOUND = pa.schema(
    [
        ("document_id", pa.string()),
        ("quote", pa.string()),
        ("claim", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("located", pa.string()),
        ("exact", pa.bool_()),
        ("span_start", pa.int32()),
        ("span_end", pa.int32()),
        ("span", pa.string()),
        ("path", pa.string()),
        ("adjusted", pa.bool_()),
    ]
)
_FOUND_DDL = "document_id string, quote string, claim string, start int, end int, located string, exact boolean, span_start int, span_end int, span string, path string, adjusted boolean"


def _searched(asked: DataFrame, documents: DataFrame, script: tuple[str, str]) -> DataFrame:
    """_FOUND rows of the distinct (document_id, quote, claim) that are in their document; a null claim chooses no span.

    A document's text travels once, and again only for each TOGETHER quotes of
    it; a group is that text and so many quotes at most.
    """
    asked = asked.select("document_id", "quote", "claim").where("document_id is not null and quote is not null").distinct()
    n = asked.groupBy("document_id").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_n"))
    asked = asked.join(n, "document_id").withColumn("_part", F.pmod(F.xxhash64("quote", "claim"), F.col("_n")).cast("int")).drop("_n")
    texts = documents.where("text is not null").dropDuplicates(["document_id"]).select("document_id", "text").join(n, "document_id")
    texts = texts.select("document_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part"), "text")

    def search(texts: pa.Table, quotes: pa.Table) -> pa.Table:
        out: list[dict] = []
        if texts.num_rows:
            document = Document(texts.column("text")[0].as_py(), script)
            for row in quotes.select(["document_id", "quote", "claim"]).to_pylist():
                at = document.locate(row["quote"])
                if at is None:
                    continue
                start, end, exact = at
                located = document.text[start:end]
                span = document.choose(located, row["claim"]) if row["claim"] is not None else None
                span = span or {"start": start, "end": end, "span": located, "path": "locator-only", "adjusted": False}
                out.append({**row, "start": start, "end": end, "located": located, "exact": exact, "span_start": span["start"], "span_end": span["end"], "span": span["span"], "path": span["path"], "adjusted": span["adjusted"]})
        return pa.Table.from_pylist(out, schema=_FOUND)

    return texts.groupBy("document_id", "_part").cogroup(asked.groupBy("document_id", "_part")).applyInArrow(search, _FOUND_DDL)


_GRAMS = pa.schema([("run", pa.string()), ("key", pa.string()), ("gram", pa.int64())])


def _grams(rows: DataFrame, key: str, text: Column, script: tuple[str, str], among: np.ndarray | None = None) -> DataFrame:
    """(run, key, gram): the hashed grams of each text, without white space and in one script, that are the least of some NEIGHBOURS.

    Texts that have SHORT characters in common have a gram in common.  With
    `among`, sorted and distinct, only these grams leave the helper.
    """
    held = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def least(text: str) -> np.ndarray:
        hashed = gram_hashes(code_points(re.sub(f"[{BLANK}]+", "", translated(text, *script))), GRAM)
        if len(hashed) < NEIGHBOURS:
            return np.zeros(0, dtype=np.int64)
        grams = hashed.view(np.int64)
        if held is not None:
            # Most texts have none of the wanted grams.
            known = held.value
            at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
            if not len(known) or not (known[at] == grams).any():
                return np.zeros(0, dtype=np.int64)
        # The least of a window, by windows of one, two, four, ... of its elements.
        size = 1
        while size < NEIGHBOURS:
            step = min(size, NEIGHBOURS - size)
            grams, size = np.minimum(grams[:-step], grams[step:]), size + step
        grams = np.unique(grams)
        return grams if held is None else np.intersect1d(grams, held.value, assume_unique=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [least(text or "") for text in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], schema=_GRAMS)

    asked = rows.select(F.col("run").cast("string").alias("run"), F.col(key).cast("string").alias("key"), text.alias("text"))
    return asked.mapInArrow(run, "run string, key string, gram long")


def _elsewhere(missed: DataFrame, filings: DataFrame, script: tuple[str, str]) -> DataFrame:
    """(run, quote, claim, document_id, position): the documents of its run in which a missed quote may be."""
    bare = F.regexp_replace("quote", rf"[{BLANK}]+", "")
    missed = missed.select("run", "quote", "claim").distinct().withColumn("_short", F.length(bare) < SHORT)
    long = missed.where("not _short").drop("_short")
    wanted = saved(_grams(long.select("run", "quote").distinct(), "quote", F.substring(bare, 1, SHORT), script))
    grams = wanted.select("gram").distinct()
    among = np.sort(grams.toArrow().column("gram").to_numpy()) if grams.count() <= MOST_GRAMS else None
    held = _grams(filings, "document_id", F.col("text"), script, among).withColumnRenamed("key", "document_id")
    met = wanted.withColumnRenamed("key", "quote").join(held, ["run", "gram"]).select("run", "quote", "document_id").distinct()
    known = filings.select("run", "document_id", "position")
    out = long.join(met, ["run", "quote"]).join(known, ["run", "document_id"])
    return out.unionByName(missed.where("_short").drop("_short").join(known, "run"))


def locate_quotes(quotes: DataFrame, documents: DataFrame, script: tuple[str, str] = PATTERN_SCRIPT) -> DataFrame:
    """`quotes` (document_id, quote, ...) with start, end, located and exact.

    A quote is found as it is, else in the other script (exact is false), else
    with other white space as well; `located` is the document's own slice from
    start to end, the first place of each kind.  A quote that is not in its
    document, blank or null, or of an unknown or null document, has nulls.

    `documents` (document_id, text): of repeated ids one counts, a null text
    has no quotes.
    """
    asked = quotes.select("document_id", "quote", F.lit(None).cast("string").alias("claim"))
    found = _searched(asked, documents, script).select(F.col("document_id").alias("_d"), F.col("quote").alias("_q"), "start", "end", "located", "exact")
    return quotes.join(found, (F.col("document_id") == F.col("_d")) & (F.col("quote") == F.col("_q")), "left").drop("_d", "_q")


def choose_spans(quotes: DataFrame, documents: DataFrame, script: tuple[str, str] = PATTERN_SCRIPT) -> DataFrame:
    """`quotes` (document_id, quote, claim, ...) with start, end, span, path and adjusted: what each claim cites.

    Every exact place of the quote is widened to whole passages, over
    neighbours (at most four, 240 characters in all) that have figures of the
    claim which are missing, and on over line ends that end no sentence.  Of
    these spans the one with most of the claim's figures is chosen, then with
    most of its units, then the shortest, then the first.  A span is a slice
    of the document.  A quote that is not found has nulls; a null claim takes
    the quote as it stands.
    """
    found = _searched(quotes, documents, script)
    found = found.select(F.col("document_id").alias("_d"), F.col("quote").alias("_q"), F.col("claim").alias("_c"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "span", "path", "adjusted")
    same = (F.col("document_id") == F.col("_d")) & (F.col("quote") == F.col("_q")) & F.col("claim").eqNullSafe(F.col("_c"))
    return quotes.join(found, same, "left").drop("_d", "_q", "_c")


def locate_claims(proposals: DataFrame, filings: DataFrame, script: tuple[str, str] = PATTERN_SCRIPT) -> tuple[DataFrame, DataFrame]:
    """Evidence of claims (run, claim_id, place, document_id, start, end, quote, path, adjusted), and (run, claim_id, reason).

    `proposals` (run: a string, claim_id, text, quotes: array of (document_id, quote));
    `filings` (run, document_id, position, text), with document ids that are
    distinct over all runs and positions that order a run's documents.  A quote is
    looked for in the document that it names, then, only if it is not there,
    in the run's other documents that share a gram with it (all of them only for
    quotes of less than SHORT characters), and the first in their order counts.  Blank
    quotes are left out.  A claim with a lost quote is rejected for the first
    one, and has no evidence; so is one without quotes; others have a null
    reason.
    """
    rows = proposals.select("run", "claim_id", "text", F.posexplode("quotes").alias("place", "_q")).select("run", "claim_id", "place", F.coalesce("text", F.lit("")).alias("claim"), F.col("_q.document_id").alias("named"), F.regexp_replace("_q.quote", r"(?U)^\s+|\s+$", "").alias("quote"))
    rows = rows.where("quote <> ''")
    known = filings.select("run", F.col("document_id").alias("named"), F.col("position").alias("named_at"))
    rows = rows.join(known.dropDuplicates(["run", "named"]), ["run", "named"], "left")
    documents = filings.select("document_id", "text")
    keys = ["run", "claim_id", "place"]
    spans = ["start", "end", "quote", "path", "adjusted"]
    found = [F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("span").alias("quote"), "path", "adjusted"]
    named = rows.where("named_at is not null").select(*keys, F.col("named").alias("document_id"), "quote", "claim")
    first = saved(named.join(_searched(named, documents, script).withColumnRenamed("start", "_s").withColumnRenamed("end", "_e"), ["document_id", "quote", "claim"]).select(*keys, "document_id", "span_start", "span_end", "span", "path", "adjusted"))
    missed = saved(rows.join(first.select(*keys), keys, "left_anti"))
    # Equal quotes of a run are looked for once, where they may be.
    elsewhere = _elsewhere(missed, filings, script)
    hits = elsewhere.join(_searched(elsewhere, documents, script).drop("start", "end"), ["document_id", "quote", "claim"])
    best = hits.groupBy("run", "quote", "claim").agg(F.min(F.struct("position", "document_id", "span_start", "span_end", "span", "path", "adjusted")).alias("_b"))
    second = missed.join(best, ["run", "quote", "claim"]).select(*keys, "_b.document_id", "_b.span_start", "_b.span_end", "_b.span", "_b.path", "_b.adjusted")
    evidence = saved(first.unionByName(second).select(*keys, "document_id", *found))
    lost = rows.join(evidence.select(*keys), keys, "left_anti").groupBy("run", "claim_id").agg(F.min(F.struct("place", "quote")).alias("_lost"))
    held = rows.select("run", "claim_id").distinct().withColumn("_held", F.lit(True))
    verdicts = proposals.select("run", "claim_id").join(lost, ["run", "claim_id"], "left").join(held, ["run", "claim_id"], "left")
    reason = F.when(F.col("_held").isNull(), "claim carries no usable quote").when(F.col("_lost").isNotNull(), F.concat(F.lit("quote is not present in any retrieved document: 「"), F.substring("_lost.quote", 1, 40), F.lit("」")))
    verdicts = verdicts.select("run", "claim_id", reason.alias("reason"))
    return evidence.join(lost, ["run", "claim_id"], "left_anti").select(*keys, "document_id", *spans), verdicts
