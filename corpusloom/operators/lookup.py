"""Lookup by section number and phrase, and the context of a question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import written

# How a question names a section.
NAMED = r"(?i)(?:penal\s+code[^.]{0,20}?|u/?s\.?\s*)(\d{1,3}[A-Z]{0,3})|(\d{1,3}[A-Z]{0,3})\s*(?:of\s+the\s+)?penal\s+code"
LIMIT = 4


def find(questions: DataFrame, entries: DataFrame, limit: int = LIMIT, counts: Callable[[Column], Column] = T.significant) -> DataFrame:
    """qid, rank, ord, phrase of the entries (ord, section, offence) that questions (qid, text) name: by number, then by the longest phrase.

    Questions and phrases meet on the phrase's rarest pair of neighbouring words (its word, where it has one), without the text; whole phrases are looked for in what is left.
    Null texts name nothing, equal phrases are one with all their entries, repeated questions have rows each. counts: which phrases are looked for.
    """
    every = lambda i: F.regexp_extract_all("text", F.lit(NAMED), F.lit(i))
    numbers = questions.select("qid", F.posexplode(F.zip_with(every(1), every(2), lambda a, b: F.upper(F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))).alias("at", "number"))
    rows = entries.select("ord", F.upper("section").alias("number"), T.headword(F.col("offence")).alias("phrase"))
    by_number = numbers.join(rows, "number").select("qid", "ord", F.col("number").alias("phrase"), F.struct(F.lit(0).alias("kind"), F.col("at").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("ord").cast("long").alias("z")).alias("place"))

    phrases = rows.where(counts(F.col("phrase"))).groupBy("phrase").agg(F.min("ord").alias("first"))
    of = lambda c: F.filter(F.split(c, r"(?U)\W+"), lambda w: w != "")
    pairs_of = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    texts = questions.select("qid", F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")).alias("t"))
    words = phrases.select("phrase", "first", of("phrase").alias("w"))
    asked = words.select("phrase", "first", F.explode(F.array_distinct(F.when(F.size("w") > 1, pairs_of(F.col("w"))).otherwise(F.col("w")))).alias("word"))
    in_texts = texts.where("t IS NOT NULL").select("qid", of("t").alias("w")).select("qid", F.explode(F.array_distinct(F.concat("w", pairs_of(F.col("w"))))).alias("word"))
    met = written(in_texts.join(asked.select("word").distinct(), "word", "left_semi"), "met")
    rare = asked.join(met.groupBy("word").agg(F.count("*").alias("n")), "word", "left").groupBy("phrase", "first").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = met.join(rare, "word").select("qid", "phrase", "first").distinct().join(texts, "qid")
    # the pattern is made for texts alone that hold the phrase's letters
    pairs = pairs.where(F.when(F.contains("t", "phrase"), F.rlike("t", F.concat(F.lit(r"(?U)\b\Q"), "phrase", F.lit(r"\E\b")))).otherwise(F.lit(False)))
    by_phrase = pairs.select("qid", "phrase", "first").join(rows.select("ord", "phrase"), "phrase").select("qid", "ord", "phrase", F.struct(F.lit(1).alias("kind"), (-F.length("phrase")).cast("long").alias("x"), F.col("first").cast("long").alias("y"), F.col("ord").cast("long").alias("z")).alias("place"))

    once = by_number.unionByName(by_phrase).groupBy("qid", "ord").agg(F.min_by("phrase", "place").alias("phrase"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place"))
    return once.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("qid", "rank", "ord", "phrase")


def context(named: DataFrame, uploaded: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, pos, identifier, text: rows that a question names, then uploads, then hits (each: qid, rank, identifier, text); an identifier counts once, where it is first."""
    tagged = named.withColumn("kind", F.lit(0)).unionByName(uploaded.withColumn("kind", F.lit(1))).unionByName(hits.withColumn("kind", F.lit(2)))
    once = tagged.groupBy("qid", "identifier").agg(F.min(F.struct("kind", "rank", "text")).alias("x"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("x.kind", "x.rank", "identifier"))
    return once.select("qid", pos.cast("long").alias("pos"), "identifier", F.col("x.text").alias("text"))


def rendered(found: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, identifiers, prompt of each question's context; without any it is refused."""
    block = F.concat(F.lit("["), "identifier", F.lit("]\n"), "text")
    parts = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "identifier", block.alias("b")))).alias("x"))  # the context of one question
    out = questions.select("qid").join(parts, "qid", "left")
    return out.select("qid", F.coalesce("x.identifier", F.array().cast("array<string>")).alias("identifiers"), F.array_join(F.transform("x", lambda y: y["b"]), "\n\n---\n\n").alias("prompt"), F.col("x").isNull().alias("refused"))


def system_fingerprint(prompt: str, model: str, index: str, k: int):
    """First 12 digits of what an answer depends on."""
    return F.substring(F.sha2(F.lit(f"{prompt}\0{model}\0{index}\0k={k}"), 256), 1, 12)
