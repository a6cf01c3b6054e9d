"""Feeds that arrive as nested JSON: submissions, tickers, announcements and pages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANNOUNCEMENT = "document_id string, id string, title string, source_published_at string, published_at string, doc_type string, ann_type string, event_type string"


def explode_submissions(feed: DataFrame, since: str | None = None, limit: int = 20, page_col: str | None = None) -> DataFrame:
    """A row for each filing of (cik, name, recent), where `recent` holds parallel arrays.

    Rows without an accession number or a primary document are skipped;
    `since` drops only rows with an earlier date; the feed's order is kept and
    stops at `limit` for each company.  With `page_col` a company has a row for
    each of its pages, in the order of that column.
    """
    page = F.col(page_col) if page_col else F.lit(0)
    zipped = feed.select("cik", "name", page.alias("_page"), F.posexplode(F.arrays_zip("recent.accessionNumber", "recent.filingDate", "recent.form", "recent.primaryDocument")).alias("place", "x"))
    rows = zipped.select("cik", "name", "_page", "place", *(F.col(f"x.{c}").alias(n) for c, n in (("accessionNumber", "accession"), ("filingDate", "published_at"), ("form", "form"), ("primaryDocument", "primary"))))
    rows = rows.where("accession <> '' and primary <> ''")
    if since is not None:
        rows = rows.where(F.col("published_at").isNull() | (F.col("published_at") == "") | (F.col("published_at") >= since))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cik").orderBy("_page", "place"))).where(F.col("k") <= limit)
    number = F.replace(F.col("accession"), F.lit("-"), F.lit(""))
    return rows.select(
        F.concat_ws(":", F.lit("edgar"), "cik", number, "primary").alias("document_id"),
        F.concat_ws(" ", "name", "form", "published_at").alias("title"),
        "published_at",
        "cik",
        "k",
    )


def resolve_tickers(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """(symbol, cik, failure): equal match without regard to case; a miss is a row, not an error."""
    known = tickers.select(F.upper("ticker").alias("_t"), F.col("cik_str").alias("cik")).groupBy("_t").agg(F.min("cik").alias("cik"))
    met = symbols.withColumn("_s", F.upper(F.trim("symbol"))).join(known, F.col("_s") == F.col("_t"), "left")
    return met.select("symbol", "cik", F.when(F.col("cik").isNull(), F.lit("not_found")).alias("failure"))


def parse_announcements(df: DataFrame, json_col: str = "body") -> DataFrame:
    """A row for each announcement of a bare array or an object with `items`; one without an id has an error."""
    body = F.trim(json_col)
    items = F.when(body.startswith("["), F.from_json(body, f"array<struct<{ANNOUNCEMENT.replace(' string', ':string')}>>")).otherwise(
        F.from_json(body, f"items array<struct<{ANNOUNCEMENT.replace(' string', ':string')}>>")["items"]
    )
    rows = df.withColumn("_a", F.explode(items))
    a = F.col("_a")
    found = F.coalesce(a["document_id"], a["id"])
    return rows.select(
        *df.columns,
        found.alias("announcement_id"),
        a["title"].alias("title"),
        F.coalesce(a["source_published_at"], a["published_at"]).alias("published"),
        F.coalesce(a["doc_type"], a["ann_type"], a["event_type"]).alias("kind"),
        F.when(found.isNull(), F.lit("announcement without an id")).alias("error"),
    )


def assemble_pages(pages: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id, text, error) from pages (offset, text, content, chunks[seq, content]), in the order of their offsets.

    A page's text is `text`, else `content`, else its chunks by seq (missing
    is 0).  Pages that repeat an offset are a cursor that did not advance.
    """
    chunks = F.array_join(F.transform(F.array_sort(F.transform("chunks", lambda c, i: F.struct(F.coalesce(c["seq"], F.lit(0)).alias("s"), i.alias("i"), c["content"].alias("c")))), lambda x: x["c"]), "")
    part = F.coalesce("text", "content", chunks, F.lit(""))
    rows = pages.select(id_col, F.col("offset"), part.alias("part"))
    whole = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"), (F.count("*") > F.countDistinct("offset")).alias("stuck"))
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    error = F.when(F.col("stuck"), F.lit("cursor did not advance")).when(~F.col("text").rlike(r"\S"), F.lit("not_found"))
    return whole.withColumn("text", text).select(id_col, "text", error.alias("error"))
