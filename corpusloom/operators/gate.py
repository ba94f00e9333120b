"""Replies to answers and citations, and the gate that lets a citation through only with a source behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import quotes

# Reasons, as they are shown.
WITHHELD = "No citation in the answer could be verified against the retrieved statutory text, so the answer was withheld."
DECLINED = "the model declined to answer"


def replies(raw: Column) -> Column:
    """struct(answer, citations, refused) of a model's reply: its JSON from the first brace to the last, else the text itself."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    said = F.from_json(block, "answer string, citations array<string>, refused boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = (block != "") & said.isNotNull() & said["_bad"].isNull()
    of = lambda c: F.from_json(c, "section string, quote string, source string")
    blank = lambda x: F.trim(F.coalesce(x, F.lit("")))
    one = lambda c: F.when(F.trim(c).startswith("{"), F.struct(blank(of(c)["section"]).alias("section"), blank(of(c)["quote"]).alias("quote"), F.coalesce(F.nullif(blank(of(c)["source"]), F.lit("")), F.lit("CrPC")).alias("source"))).otherwise(F.struct(F.trim(c).alias("section"), F.lit("").alias("quote"), F.lit("CrPC").alias("source")))
    none = F.array().cast("array<struct<section:string,quote:string,source:string>>")
    cited = F.filter(F.transform(F.coalesce(said["citations"], F.array().cast("array<string>")), one), lambda c: c["section"] != "")
    return F.struct(F.when(good, blank(said["answer"])).otherwise(F.trim(raw)).alias("answer"), F.when(good, cited).otherwise(none).alias("citations"), F.coalesce(good & said["refused"], F.lit(False)).alias("refused"))


def gate(citations: DataFrame, sources: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations (qid, ord, section, source, quote) with number, document, kept, reason, display, verified, repair.

    sources: document, number, body, note; the last ord of a row of a table or the first of a section has to be chosen before. allowed: qid, identifier; a
    question without any allows all. A quotation that fails goes, its citation stays.
    """
    rows = citations.withColumns({"number": T.section_number(F.col("section")), "document": T.source_code(F.col("source"))})
    documents = sources.select("document").distinct().withColumn("_ingested", F.lit(True))
    rows = rows.join(documents, "document", "left").join(sources.select("document", "number", "body", "note"), ["document", "number"], "left")
    lists = allowed.select("qid").distinct().withColumn("_limits", F.lit(True))
    rows = rows.join(lists, "qid", "left").withColumn("_id", F.concat("document", F.lit(":"), "number")).join(allowed.select("qid", F.col("identifier").alias("_id"), F.lit(True).alias("_allowed")).distinct(), ["qid", "_id"], "left")
    none = F.coalesce(F.col("body"), F.lit("")) == ""
    reason = (
        F.when(F.col("number").isNull(), "unparseable section reference")
        .when((F.col("document") == "Uploaded") & none, "no such passage in the uploaded document")
        .when((F.col("document") == "ScheduleII") & F.col("body").isNull(), "no such offence in Schedule II")
        .when(F.col("_ingested").isNull(), F.concat("document", F.lit(" is not part of the ingested corpus")))
        .when(F.col("body").isNull(), F.concat(F.lit("no section "), "number", F.lit(" in the "), "document"))
        .when(F.col("_limits").isNotNull() & F.col("_allowed").isNull(), "not present in the retrieved context")
    )
    rows = rows.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    long = F.col("kept") & (F.length(T.canonical(F.coalesce("quote", F.lit("")))) >= quotes.LEAST)
    rows = rows.withColumn("x", quotes.checked(F.when(long, F.col("quote")), F.when(long, F.col("body")), F.when(long, F.col("note"))))
    failed = long & ~F.col("x.verified")
    shown = F.when(~F.col("kept") | failed, "").when(long, F.col("x.display")).otherwise(F.trim(F.coalesce("quote", F.lit(""))))
    return rows.select(*citations.columns, "number", "document", "kept", F.when(failed, "quoted text does not appear in the section").otherwise(F.col("reason")).alias("reason"), shown.alias("display"), F.col("x.verified").alias("verified"), F.col("x.repair").alias("repair"), F.when(F.col("kept"), F.col("note")).alias("note"))


def answered(answers: DataFrame, gated: DataFrame) -> DataFrame:
    """qid, refused, reason, text of answers (qid, answer, refused): refused ones give their own words, those without a citation left are withheld."""
    left = gated.where("kept").groupBy("qid").agg(F.count("*").alias("_n"))
    rows = answers.join(left, "qid", "left")
    withheld = ~F.col("refused") & F.col("_n").isNull()
    reason = F.when(F.col("refused"), F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(DECLINED))).when(withheld, WITHHELD)
    return rows.select("qid", (F.col("refused") | withheld).alias("refused"), reason.alias("reason"), F.coalesce(reason, F.col("answer")).alias("text"))


def grouped(gated: DataFrame) -> DataFrame:
    """qid, document, number, place (in order of first mention), quotes, n_quotes, n_verified, note of citations that were kept."""
    kept = gated.where("kept")
    out = kept.groupBy("qid", "document", "number").agg(F.min("ord").alias("place"), F.array_sort(F.collect_set(F.when(F.col("display") != "", F.col("display")))).alias("quotes"), F.count_if("verified").alias("n_verified"), F.min_by("note", F.when(F.col("note").isNotNull(), F.col("ord"))).alias("note"))
    return out.withColumn("n_quotes", F.size("quotes").cast("long"))


def with_facts(grouped_: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations of the table with the facts of its last row for that section."""
    names = [c for c in entries.columns if c not in ("ord", "section")]
    last = entries.groupBy("section").agg(F.max_by(F.struct(*names), "ord").alias("offence")).withColumn("document", F.lit("ScheduleII")).withColumnRenamed("section", "number")
    return grouped_.join(last, ["document", "number"], "left")
