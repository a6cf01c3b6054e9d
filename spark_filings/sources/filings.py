"""Filings, catalogues and responses as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import title_of
from ..operators.lineage import saved

FILING = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("provider", T.StringType()),
    ]
)


def read_filings(spark: SparkSession, root: str, provider: str = "local", longest: int = 80) -> DataFrame:
    """A row for each .txt or .md file under `root`; the id is its path below it.

    The title is the first line that is not blank, else the file's name.
    Files without any text are left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = files.select(F.col("value").alias("text"), path.alias("path"))
    base = root.rstrip("/").split("://")[-1]
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(F.col("text").rlike(r"\S")).select(
        F.regexp_replace("path", rf"^.*?\Q{base}\E/", "").alias("document_id"),
        F.coalesce(F.nullif(title_of(F.col("text"), longest), F.lit("")), name).alias("title"),
        "text",
        F.lit(provider).alias("provider"),
    )


def disambiguate_ids(df: DataFrame, id_col: str, order: list[str | Column]) -> DataFrame:
    """Repeated ids become id, id#2, id#3, ... in the given order.

    Rows are dealt by range and numbered within it, so that a frequent id is
    numbered by many tasks; only the counts of ids that go on from one range
    into the next are handed on.
    """
    dealt = df.repartitionByRange(id_col, *order).withColumn("_part", F.spark_partition_id())
    # Ranges are drawn from a sample, so they are fixed before they are used twice.
    dealt = saved(dealt)
    counts = dealt.groupBy("_part", F.col(id_col).alias("_of")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where("_before > 0").select(F.col("_part").alias("_in"), "_of", "_before")
    # At most one id goes on from a range into the next, so `before` has no more rows than there are ranges.
    place = F.row_number().over(Window.partitionBy("_part", id_col).orderBy(*order))
    placed = dealt.withColumn("_place", place).join(F.broadcast(before), (F.col("_part") == F.col("_in")) & F.col(id_col).eqNullSafe(F.col("_of")), "left")
    placed = placed.withColumn("_place", F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_part", "_in", "_of", "_before")
    return placed.withColumn(id_col, F.when(F.col("_place") == 1, F.col(id_col)).otherwise(F.concat_ws("#", id_col, "_place"))).drop("_place")


def parse_responses(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add output and error: the text of a reply given plainly or as JSON in one of the known shapes."""
    raw = F.col(raw_col)
    is_json = F.trim(raw).rlike(r'^[\{"]')
    plain = F.regexp_extract(F.trim(raw), r'(?s)^"(.*)"$', 1)
    found = F.coalesce(*(F.get_json_object(raw, p) for p in ("$.output", "$.text", "$.response", "$.choices[0].message.content")), F.nullif(plain, F.lit("")))
    out = F.coalesce(F.when(is_json, found), raw)
    blank = out.isNull() | ~out.rlike(r"\S")
    return df.withColumn("output", out).withColumn("error", F.when(blank, F.lit("agent returned empty output")))


def list_documents(catalog: DataFrame, symbol: str | None = None, since: str | None = None, limit: int = 20) -> DataFrame:
    """Newest first; undated rows pass `since` and come last."""
    rows = catalog
    if symbol is not None:
        rows = rows.where((F.col("symbol") == symbol) | F.col("document_id").contains(symbol))
    if since is not None:
        rows = rows.where(F.col("published_at").isNull() | (F.col("published_at") >= since))
    return rows.orderBy(F.col("published_at").desc_nulls_last(), "document_id").limit(limit)


def search_instruments(instruments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Rows whose symbol equals the query or whose name holds it, without regard to case."""
    asked = query.strip().upper()
    hit = (F.upper("symbol") == asked) | F.upper("name").contains(asked)
    return instruments.where(hit).orderBy("symbol").limit(limit)


#: Grades by rank.
SEVERITY = {"unknown": 0, "blue": 1, "amber": 2, "red": 3}


def worst_of_group(grade: Column, order: Column) -> Column:
    """Aggregate: `worst_grade` of a group's grades in an order, without collecting them."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return F.max_by(grade, F.when(grade.isNotNull(), F.struct(F.coalesce(rank[grade], F.lit(0)), -order)))


def worst_grade(grades: Column) -> Column:
    """The worst of an array of grades, the first of equals; null if there is none."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    ranked = F.transform(F.array_compact(grades), lambda g, i: F.struct(F.coalesce(rank[g], F.lit(0)).alias("rank"), (-i).alias("at"), g.alias("grade")))
    return F.array_max(ranked)["grade"]
