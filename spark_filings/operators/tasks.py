"""Tasks with their gold and contexts: reading, choosing and checking them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The languages and types that a task may have.
LANGUAGES = ("zh-CN", "zh-TW", "en")

TASK = "id string, lang string, type string, prompt string, context_files array<string>, scoring array<string>, trap boolean"
GOLD = (
    "numbers array<struct<id:string,verbatim:string,canonical:struct<value:string,unit:string,derived:boolean>,source_quote:string>>,"
    "key_points array<struct<id:string,point:string,required:boolean>>,"
    "claim_evidence array<struct<point_id:string,evidence_quote:string,alternate_quotes:array<string>,source_file:string>>,"
    "must_refuse boolean, forbidden array<string>, counterevidence_required array<string>, answer_absent boolean"
)


def _read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", "true").json(pattern).withColumn("_path", F.input_file_name())
    return rows.withColumn("folder", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)).withColumn("variant", F.regexp_extract("_path", r"\.([A-Za-z-]+)\.json$", 1))


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks from `<folder>/<task>/task.json` and `task.<lang>.json`, one row for each language, with the folder's name as `folder`."""
    return _read(spark, f"{folder}/*/task*.json", TASK).drop("_path", "variant")


def read_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold by (folder, lang) for each task of `read_tasks`; a language without its own has that of the base file."""
    rows = _read(spark, f"{folder}/*/gold*.json", GOLD)
    fields = [c for c in rows.columns if c not in ("_path", "folder", "variant")]
    packed = rows.select("folder", "variant", F.struct(*fields).alias("gold"))
    base = packed.where("variant = ''").select("folder", F.col("gold").alias("base"))
    tasks = read_tasks(spark, folder).select("folder", "lang")
    out = tasks.join(packed, (tasks["folder"] == packed["folder"]) & (tasks["lang"] == packed["variant"]), "left").select(tasks["folder"], "lang", "gold")
    return out.join(base, "folder", "left").select("folder", "lang", F.coalesce("gold", "base").alias("gold")).select("folder", "lang", "gold.*")


def select_tasks(tasks: DataFrame, ids: list[str] | None = None, langs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen tasks, unknown ids): all tasks but traps, or those named by `ids`; of some languages."""
    known = tasks.select("id").distinct()
    if ids is None:
        chosen, unknown = tasks.where(~F.coalesce("trap", F.lit(False))), known.where("false")
    else:
        asked = tasks.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        chosen, unknown = tasks.join(F.broadcast(asked), "id", "left_semi"), asked.join(known, "id", "left_anti")
    return (chosen if langs is None else chosen.where(F.col("lang").isin(*langs))), unknown


def _violation(rows: DataFrame, code: str, reference: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), reference.cast("string").alias("reference"))


def validate_tasks(tasks: DataFrame, points: DataFrame, evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """(code, reference) for each broken rule.

    `tasks` is (task, lang, type, prompt, context_files), `points` (task,
    point_id), `evidence` (task, point_id, quote, source_file), `contexts`
    (task, path, text).  Rules: a task has a prompt, a known language and no
    second row of its language; a task of several documents has two contexts;
    evidence names a point of its task, a context of its task, and quotes a
    context of its task verbatim: the named one, if it names one.
    """
    key = F.concat_ws(":", "task", "lang")
    repeated = tasks.groupBy("task", "lang").count().where("count > 1")
    named = evidence.where("source_file is not null")
    paths = contexts.select("task", F.col("path").alias("source_file")).distinct()
    quotes = evidence.where("quote is not null").select("task", "point_id", "quote", "source_file")
    # Quotes go to the contexts, and only what is found comes back.
    found = quotes.join(contexts, "task").where((F.col("source_file").isNull() | (F.col("source_file") == F.col("path"))) & F.col("text").contains(F.col("quote"))).select("task", "point_id", "quote").distinct()
    evidence_key = F.concat_ws(":", "task", "point_id")
    parts = [
        _violation(tasks.where("prompt is null or trim(prompt) = ''"), "no_prompt", key),
        _violation(tasks.where(~F.coalesce(F.col("lang").isin(*LANGUAGES), F.lit(False))), "unknown_language", key),
        _violation(repeated, "repeated_task", key),
        _violation(tasks.where((F.col("type") == "multi_doc") & (F.coalesce(F.size("context_files"), F.lit(0)) < 2)), "few_contexts", key),
        _violation(evidence.join(points.select("task", "point_id").distinct(), ["task", "point_id"], "left_anti"), "unknown_point", evidence_key),
        _violation(named.join(paths, ["task", "source_file"], "left_anti"), "unknown_source", evidence_key),
        _violation(quotes.join(found, ["task", "point_id", "quote"], "left_anti"), "unquoted", evidence_key),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_scores(scores: DataFrame, folder: str) -> None:
    """Scores as Parquet by run; a run that is written again replaces itself alone."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(folder)
