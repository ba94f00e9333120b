"""Readers and writers of the corpus's files. Empty or missing inputs give empty tables where a reader says so."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import asserted, written

GOLD = "id string, question string, language string, slice string, gold_sections array<string>, answerable boolean, requires_acts array<string>, notes string, verified_against string"
ANSWERS = "question_id string, text string, citations array<struct<section:string,quote:string,source:string>>, refused boolean, model string, raw string, error string, retrieved_sections array<string>"
MOST_BYTES = 20 << 20
SHOWN = 600


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of a JSON Lines file in order; a broken line is an error where it is read, an id that comes twice is one at once, whatever is read."""
    rows = spark.read.schema(GOLD).json(path, mode="FAILFAST").where("id is not null")
    asserted(rows.groupBy("id").agg(F.count("*").alias("times")), F.col("times") > 1, "duplicate id", F.col("id"))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a JSON Lines file, the last of each question; none where the file isn't there."""
    try:
        rows = spark.read.schema(ANSWERS).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWERS)
    names = [c for c in rows.columns if c != "question_id"]
    last = rows.where("question_id is not null").withColumn("_ord", F.monotonically_increasing_id()).groupBy("question_id").agg(F.max_by(F.struct(*names), "_ord").alias("x"))
    return last.select("question_id", "x.*")


def save_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON Lines in UTF-8, signs of all scripts as they are."""
    rows.write.mode("overwrite").json(path)


def load_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def save_index(chunks: DataFrame, path: str, model: str) -> None:
    """An index: its chunks with vectors as Parquet, then one row of facts, whose presence says that it is whole."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/chunks").agg(F.lit(model).alias("model_name"), F.count("*").alias("count")).write.mode("overwrite").parquet(f"{path}/meta")


def index_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a whole index; an error where their number isn't the one that was written."""
    rows, said = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/meta").first()["count"]
    if rows.count() != said:
        raise ValueError(f"{path} has other rows than were written")
    return rows


def acts(spark: SparkSession, path: str) -> DataFrame:
    """act_id, html, source_hash of the pages named act-print-<number>.html in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "act-print-*.html").load(path)
    number = F.regexp_extract("path", r"act-print-(\d+)\.html$", 1).try_cast("int")
    return files.select(number.alias("act_id"), F.decode("content", "UTF-8").alias("html"), F.sha2("content", 256).alias("source_hash")).where("act_id is not null")


def parsed(spark: SparkSession, folder: str, store: str, version: str, parse) -> tuple[DataFrame, dict[str, int]]:
    """Parsed pages of an act folder, kept in a store by the pages' hashes and the parser's version; only pages that aren't there are parsed.

    parse: from pages (act_id, html) to rows with act_id. Returns the rows of all pages with their source_hash, and how many pages were parsed and found. A folder without pages is an error.
    Each run that parses adds a folder to the store; stale rows stay there unread. A page that gives no rows is remembered as parsed.
    """
    pages = acts(spark, folder)
    listed = pages.select("act_id", "source_hash")
    total = listed.count()
    if not total:
        raise FileNotFoundError(f"no act pages in {folder}")
    known = lambda kind: spark.read.parquet(f"{store}/*/{kind}").where(F.col("parser") == version)
    done = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    fresh = pages.join(known("done").select("act_id", "source_hash"), ["act_id", "source_hash"], "left_anti") if there else pages
    fresh = written(fresh, "pages")
    n = fresh.count()
    if n:
        name = f"{store}/{uuid.uuid4().hex}"
        facts = fresh.select("act_id", "source_hash", F.lit(version).alias("parser"))
        parse(fresh.select("act_id", "html")).join(facts, "act_id").write.option("compression", "zstd").parquet(f"{name}/rows")
        facts.write.parquet(f"{name}/done")
    return known("rows").join(listed, ["act_id", "source_hash"], "left_semi").drop("parser"), {"parsed": n, "kept": total - n}


def uploads(files: DataFrame) -> DataFrame:
    """document_id, filename, pages, text, error of uploads (content, filename, media_type): plain text is read, what can't be says why."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    is_pdf = F.startswith("content", F.lit(b"%PDF")) | (F.col("media_type") == "application/pdf")
    plain = F.col("media_type").startswith("text/") | F.lower("filename").rlike(r"\.(txt|md)$")
    error = (
        F.when(F.length("content") > MOST_BYTES, "larger than 20 MiB").when(F.coalesce(is_pdf, F.lit(False)), "no PDF reader is installed")
        .when(~F.coalesce(plain, F.lit(False)), "neither text nor PDF").when(text.isNull(), "not UTF-8").when(F.trim(text) == "", "empty")
    )
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("document_id"), "filename", F.when(error.isNull(), 1).alias("pages"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def save_run(path: str, summary: DataFrame, answers: DataFrame, scores: DataFrame) -> None:
    """A run: one row of summary, its answers, its scores with answers cut to SHOWN characters."""
    answers.write.mode("overwrite").json(f"{path}/answers")
    scores.withColumn("answer_text", F.substring("answer_text", 1, SHOWN)).write.mode("overwrite").json(f"{path}/per_question")
    summary.write.mode("overwrite").json(f"{path}/summary")


def complete_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of the runs stage-* in a folder that aren't partial, by model and stage."""
    rows = spark.read.json(f"{path}/stage-*/summary")
    partial = F.coalesce("partial", F.lit(False)) if "partial" in rows.columns else F.lit(False)
    return rows.where(~partial).orderBy("model", "stage")


def uncached(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) without a reply in the cache (key, reply, error); errors are never kept."""
    return asked.join(cache.where("error is null").select("key"), "key", "left_anti")


def reply_key(system: str, model: str, fingerprint: str, question: str = "question"):
    return F.sha2(F.concat_ws("\0", F.lit(system), F.lit(model), F.lit(fingerprint), question), 256)


def run_folder(stage: int, provider: str | None = None, slices: list[str] | None = None, partial: bool = False, experiment: str | None = None) -> str:
    """Where a run is written; a partial one to scratch, an experiment's to its own folder."""
    if experiment is not None and (not re.fullmatch(r"[\w.-]+", experiment) or ".." in experiment):
        raise ValueError(f"not a name for an experiment: {experiment!r}")
    name = "-".join([f"stage-{stage}", *([provider] if provider else []), *(slices or [])])
    return "/".join([*(["experiments", experiment] if experiment else []), *(["scratch"] if partial and not experiment else []), name])


def act_paths(act_id, base: str = ""):
    """struct(url, cache): the page of an act below the base address, and the file that keeps it."""
    name = F.concat(F.lit("act-print-"), act_id.cast("string"), F.lit(".html"))
    return F.struct(F.concat(F.lit(f"{base.rstrip('/')}/" if base else ""), name).alias("url"), F.concat(F.lit("acts/"), name).alias("cache"))


def table_paths(source: str = "schedule-ii.pdf") -> dict[str, str]:
    """Where the positioned table's file and its parsed rows are kept."""
    return {"source": f"acts/{source}", "parsed": f"acts/{source.rsplit('.', 1)[0]}.jsonl"}
