"""Sentences that may speak against an answer: uncited ones in the paragraphs that its question cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import PATTERN_SCRIPT
from ..functions.passages import sentences_at

# The words of dissent, in both scripts, and how much is taken.
DISSENT = r"不认可|不予认可|明确反馈不|明確反饋不|异议|異議|反对|反對|不同意|暂未收到|暫未收到|尚未回复|尚未回覆|未回复|未回覆|不具备.{0,6}基础|不具備.{0,6}基礎|不构成|不構成"
LEAST_CHARACTERS = 8
SENTENCES = 4
QUESTIONS = 3

#: Offsets that a bin of the interval joins has.
BIN = 1024


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Each range once for each bin that it touches."""
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / BIN))))


def adversative_targets(questions: DataFrame, evidence: DataFrame, documents: DataFrame, pattern: str = DISSENT, script: tuple[str, str] = PATTERN_SCRIPT, sentences: int = SENTENCES, most: int = QUESTIONS) -> DataFrame:
    """(run, question_id, rank, n_hits, place, document_id, start, end, text, matched): what to read again for each question.

    `questions` (run, question_id, position), `evidence` (run, question_id,
    position, document_id, start, end) what its claims cite, `documents`
    (document_id, text).  Paragraphs are parted by blank lines.  Of those that
    a question cites, the sentences that touch none of its evidence, have
    LEAST_CHARACTERS that are no white space, and match the pattern, are hits;
    the sentences before and after a hit in its paragraph are its neighbours.  Hits come
    first, in the order of evidence and place, then neighbours; `sentences` of
    a question at most (from place 0), and of a run the `most` questions with
    most hits (ties: by position; rank from 1).

    Evidence meets paragraphs and sentences by bins of offsets, so that only
    what lies near is compared.  Evidence out of a document's bounds, of
    unknown documents or questions is left out.
    """
    texts = documents.where("text is not null").dropDuplicates(["document_id"])
    all_ = texts.select("document_id", F.length("text").alias("_length"), F.explode(sentences_at(F.col("text"))).alias("s")).select("document_id", "_length", "s.*")
    near = Window.partitionBy("document_id", "paragraph").orderBy("start")
    span = F.struct("start", "end", "text")
    all_ = all_.withColumn("_before", F.lag(span).over(near)).withColumn("_after", F.lead(span).over(near))
    asked = evidence.join(questions.select("run", "question_id"), ["run", "question_id"], "left_semi")
    cited = asked.select("run", "question_id", "position", "document_id", F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s >= 0 and _e > _s")
    # The paragraph in which evidence starts.
    paragraphs = all_.select("document_id", "paragraph", "_length", "region_start", "region_end").distinct()
    starts = cited.withColumn("_bin", F.floor(F.col("_s") / BIN))
    held = starts.join(_binned(paragraphs, "region_start", "region_end"), ["document_id", "_bin"]).where((F.col("_s") >= F.col("region_start")) & (F.col("_s") < F.col("region_end")) & (F.col("_e") <= F.col("_length")))
    owned = held.groupBy("run", "question_id", "document_id", "paragraph").agg(F.min("position").alias("_order"))
    read = owned.join(all_, ["document_id", "paragraph"])
    keys = ["run", "question_id", "document_id", "start", "end"]
    met = _binned(read.select(*keys), "start", "end").join(_binned(cited.select("run", "question_id", "document_id", "_s", "_e"), "_s", "_e"), ["run", "question_id", "document_id", "_bin"])
    touched = met.where((F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start"))).select(*keys).distinct()
    said = F.translate("text", *script).rlike(pattern) & (F.length(F.regexp_replace("text", r"(?U)\s+", "")) >= LEAST_CHARACTERS)
    hits = read.where(said).join(touched, keys, "left_anti")
    own = F.struct(F.lit(0).alias("kind"), F.col("_order"), F.col("document_id").alias("_d"), F.col("start").alias("_at"), F.lit(0).alias("_side"))

    def beside(side: int, which: str) -> Column:
        rank = F.struct(F.lit(1).alias("kind"), F.col("_order"), F.col("document_id").alias("_d"), F.col("start").alias("_at"), F.lit(side).alias("_side"))
        return F.when(F.col(which).isNotNull(), F.struct(rank.alias("_rank"), F.col(which)["start"].alias("start"), F.col(which)["end"].alias("end"), F.col(which)["text"].alias("text")))

    found = hits.select("run", "question_id", "document_id", F.explode(F.array_compact(F.array(F.struct(own.alias("_rank"), "start", "end", "text"), beside(0, "_before"), beside(1, "_after")))).alias("_c")).select("run", "question_id", "document_id", "_c.*")
    once = found.groupBy("run", "question_id", "document_id", "start", "end", "text").agg(F.min("_rank").alias("_rank"))
    place = F.row_number().over(Window.partitionBy("run", "question_id").orderBy("_rank")) - 1
    kept = once.withColumn("place", place).where(F.col("place") < sentences)
    n = hits.groupBy("run", "question_id").agg(F.count("*").alias("n_hits")).join(questions.groupBy("run", "question_id").agg(F.min("position").alias("_p")), ["run", "question_id"])
    best = n.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n_hits"), "_p", "question_id"))).where(F.col("rank") <= most)
    return kept.join(best, ["run", "question_id"]).select("run", "question_id", "rank", "n_hits", "place", "document_id", "start", "end", "text", (F.col("_rank.kind") == 0).alias("matched"))
