"""Scores of answers, aggregates over questions, checks of gold labels, retrieval at k, changes between two scorings.

Answers with an error count nothing. Answers, gold and the (document, number) of sources are unique; an answer without citations has counts of 0. Rows that repeat a citation
count each. Null quotations are as empty ones and aren't checked. Empty tables give empty results, summaries of nothing have null rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.text import ratio
from corpusloom.operators import index, quotes
from corpusloom.sources.scratch import asserted, written

#: Columns of a question's scores that are counts.
COUNTS = ("made", "existing", "correct", "checked", "valid", "repaired", "misattributed", "fabricated", "overelided", "recomposed", "retrieved")
CUTS = (1, 3, 5, 8, 10, 20)


#: Names the rules of verified() and scored(); stored scores of other rules are made anew.
SCORER = "1"


def verified(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (qid, ord, section, source, quote) with number, document, exists, checked, verified, repair and, where a quotation failed, verdict.

    sources: ord, document, number, body, note; their order says which source a misattributed quotation is from.
    """
    rows = citations.withColumns({"number": T.section_number(F.col("section")), "document": T.source_code(F.col("source"))})
    rows = rows.join(sources.select("document", "number", F.col("ord").alias("cited"), "body", "note"), ["document", "number"], "left")
    rows = rows.withColumn("exists", F.coalesce(F.col("body") != "", F.lit(False)))
    rows = rows.withColumn("checked", F.col("exists") & (F.length(T.canonical(F.coalesce("quote", F.lit("")))) >= quotes.LEAST))
    only = lambda c: F.when(F.col("checked"), F.col(c))
    rows = rows.withColumn("x", quotes.checked(only("quote"), only("body"), only("note"))).drop("body", "note")
    rows = written(rows.withColumns({"verified": F.col("checked") & F.col("x.verified"), "repair": F.col("x.repair")}).drop("x").withColumn("item_id", F.monotonically_increasing_id()), "checked")
    failed = rows.where("checked AND NOT verified").select("item_id", "quote", "cited")
    verdicts = quotes.explained(failed, sources.where("body <> ''").select(F.col("ord").alias("doc_id"), T.canonical(F.col("body")).alias("c")))
    return rows.join(verdicts.select("item_id", "verdict"), "item_id", "left").drop("item_id", "cited")


def scored(answers: DataFrame, citations: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of answers (qid, refused, error, retrieved array) with their citations (qid, document, number, exists, checked, verified, repair, verdict) by gold (qid, answerable, targets array of document:number).

    A citation is correct if its identifier is a target, or its bare number is a target's. Answers without gold are left out.
    """
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"^[^:]*:", ""))
    # merged by qid: a row for each question is a few bytes in a file and many times that in a broadcast
    gold = gold.hint("merge")
    both = citations.join(gold.select("qid", "targets"), "qid").join(answers.where("error IS NULL").select("qid").hint("merge"), "qid", "left_semi")
    right = F.array_contains("targets", F.concat("document", F.lit(":"), "number")) | F.array_contains(bare(F.col("targets")), F.col("number"))
    verdict = lambda v: F.count_if(F.col("checked") & (F.col("verdict") == v))
    sums = both.groupBy("qid").agg(
        F.count("*").alias("made"), F.count_if("exists").alias("existing"), F.count_if(right).alias("correct"), F.count_if("checked").alias("checked"),
        F.count_if(F.col("checked") & F.col("verified")).alias("valid"), F.count_if(F.col("checked") & F.col("verified") & (F.col("repair") != "")).alias("repaired"),
        verdict("misattributed").alias("misattributed"), verdict("fabricated").alias("fabricated"), verdict("overelided").alias("overelided"), verdict("recomposed").alias("recomposed"),
    )
    rows = answers.join(gold, "qid").join(sums, "qid", "left").withColumn("found", F.coalesce("retrieved", F.array().cast("array<string>")))
    hit = F.arrays_overlap("targets", "found") | F.arrays_overlap(bare(F.col("targets")), bare(F.col("found")))
    good = F.col("error").isNull()
    rows = rows.withColumns({"retrieval_hit": good & F.coalesce(hit, F.lit(False)), "retrieved": F.when(good, F.size("found")).otherwise(0).cast("long")}).drop("found")
    return predicates(rows.na.fill(0, [c for c in COUNTS if c != "retrieved"]))


def provenance(answers: DataFrame, citations: DataFrame, gold: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, provenance: a hash of all that an answer's score follows from, but for the sources that it doesn't cite."""
    bodies = sources.select("document", "number", F.sha2(F.to_json(F.struct("body", "note")), 256).alias("body_hash"))
    cited = citations.withColumns({"number": T.section_number(F.col("section")), "document": T.source_code(F.col("source"))}).join(bodies, ["document", "number"], "left")
    cited = cited.groupBy("qid").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "section", "source", "quote", "body_hash")))), 256).alias("cited"))  # an answer's citations
    said, gold_said = F.struct(*(c for c in sorted(answers.columns) if c != "qid")).alias("said"), F.struct(*(c for c in sorted(gold.columns) if c != "qid")).alias("gold")
    rows = answers.select("qid", said).join(gold.select("qid", gold_said).hint("merge"), "qid").join(cited, "qid", "left")
    return rows.select("qid", F.sha2(F.to_json(F.struct("said", "gold", "cited", F.lit(SCORER).alias("scorer"))), 256).alias("provenance"))


def rescored(stored: DataFrame | None, answers: DataFrame, citations: DataFrame, gold: DataFrame, sources: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Scores of all answers with provenance and corpus, of which only those are made anew that something has changed for; and how many were kept, scored and are missing.

    An answer keeps its stored score if it, its gold, the bodies that it cites and the scorer are as they were; one with a failed quotation, whose verdict
    follows from all sources, also needs these as they were. Gold without an answer is missing. Nothing is written but tables on the way.
    """
    now = written(provenance(answers, citations, gold, sources), "provenance").hint("merge")  # as in scored()
    whole = index.digest(sources.withColumn("h", F.sha2(F.to_json(F.struct("body", "note")), 256)).withColumn("of", F.concat_ws(":", "document", "number")).withColumn("all", F.lit(0)), ["all"], "of", "h").first()
    corpus = whole["digest"] if whole else ""
    if stored is None:
        todo, kept = now, None
    else:
        failed = sum((F.col(c) for c in ("misattributed", "fabricated", "overelided", "recomposed")), F.lit(0)) > 0
        same = stored.where(~failed | (F.col("corpus") == corpus))
        kept = same.join(now, ["qid", "provenance"], "left_semi").withColumn("corpus", F.lit(corpus))
        todo = now.join(kept.select("qid"), "qid", "left_anti")
    todo = written(todo, "to_score").hint("merge")
    fresh = lambda df: df.join(todo.select("qid"), "qid", "left_semi")
    new = scored(fresh(answers), verified(fresh(citations), sources), gold).join(todo, "qid").withColumn("corpus", F.lit(corpus))
    rows = written(new if kept is None else new.unionByName(kept), "scores")
    total, n = rows.count(), todo.count()
    return rows, {"scored": n, "kept": total - n, "missing": gold.join(answers.select("qid").hint("merge"), "qid", "left_anti").count()}


#: What a summary says of the run itself, which a new scoring keeps.
CARRIED = ("stage", "system", "provider", "model", "elapsed_seconds", "cache_hits", "partial")


def resummarised(scores: DataFrame, previous: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the metrics of scores, what previous (one row) says of the run, rescored_with, dataset_questions and missing_answers."""
    found = scores.agg(*metrics()).join(gold.agg(F.count("*").alias("dataset_questions")))
    found = found.join(previous.select(*(c for c in CARRIED if c in previous.columns)))
    return found.withColumns({"rescored_with": F.lit(SCORER), "missing_answers": F.col("dataset_questions") - F.col("questions")})


def identity(summaries: DataFrame) -> DataFrame:
    """summaries, if in each the rates of valid quotations and of the four failures add up to 1 (as far as they are rounded); an error else, whatever is read."""
    rates = ("excerpt_validity", "misattribution_rate", "fabrication_rate", "overelision_rate", "recomposition_rate")
    return asserted(summaries, F.abs(sum((F.col(c) for c in rates), F.lit(-1.0))) > len(rates) * 0.00005 + 1e-9, "rates of quotations add up to another number than 1:", F.concat_ws(", ", *(F.col(c).cast("string") for c in rates)))


def predicates(rows: DataFrame) -> DataFrame:
    """Adds measured, decided_correctly and has_correct_citation."""
    measured = F.col("error").isNull()
    return rows.withColumns({"measured": measured, "decided_correctly": measured & (F.col("refused") != F.col("answerable")), "has_correct_citation": F.col("correct") > 0})


def metrics() -> list[Column]:
    """All rates and counts of a run over predicates(): rates are over measured questions, and null where there is nothing to divide by."""
    m, answerable = F.col("measured"), F.col("measured") & F.col("answerable")
    total = lambda c, where=m: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    cited, quotes = total("made"), total("checked")
    share = {"misattribution_rate": "misattributed", "fabrication_rate": "fabricated", "overelision_rate": "overelided", "recomposition_rate": "recomposed"}
    return [
        F.count("*").alias("questions"), F.count_if(m).alias("measured_n"), F.count_if(~m).alias("errors"), cited.alias("citations_made"),
        ratio(total("existing"), cited).alias("citation_existence"),
        F.when(cited > 0, F.round(1 - total("existing") / F.nullif(cited, F.lit(0)), 4)).alias("hallucinated_citation_rate"),
        ratio(total("correct", answerable), total("made", answerable)).alias("citation_precision"),
        ratio(F.count_if(answerable & F.col("has_correct_citation")), F.count_if(answerable)).alias("answer_hit_rate"),
        F.when(total("retrieved") > 0, ratio(F.count_if(answerable & F.col("retrieval_hit")), F.count_if(answerable))).alias("retrieval_recall"),
        ratio(total("valid"), quotes).alias("excerpt_validity"),
        ratio(total("valid") - total("repaired"), quotes).alias("excerpt_validity_unrepaired"),
        *(ratio(total(c), quotes).alias(name) for name, c in share.items()),
        quotes.alias("quotes_checked"), total("repaired").alias("quotes_repaired"),
        *(total(c).alias(f"quotes_{c}") for c in share.values()),
        ratio(F.count_if("decided_correctly"), F.count_if(m)).alias("refusal_accuracy"),
        ratio(F.count_if(m & ~F.col("answerable") & F.col("refused")), F.count_if(m & ~F.col("answerable"))).alias("refused_when_unanswerable"),
        ratio(F.count_if(answerable & F.col("refused")), F.count_if(answerable)).alias("refused_when_answerable"),
    ]


def gold_issues(gold: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """id, label, issue of gold (id, answerable, labels array of code-number, phrase): the first that applies, of the question and of each label.

    acts: code, ingested. sections: code, number, repealed, text.
    """
    n = F.size(F.coalesce("labels", F.array().cast("array<string>")))
    of_question = F.when(F.col("answerable") & (n == 0), "answerable without labels").when(~F.col("answerable") & (n > 0), "unanswerable with labels")
    whole = gold.select("id", F.lit(None).cast("string").alias("label"), of_question.alias("issue"))
    each = gold.select("id", "phrase", F.explode("labels").alias("label")).withColumns({"code": F.split("label", "-", 2)[0], "number": F.regexp_replace("label", "^[^-]*-", "")})
    each = each.join(acts, "code", "left").join(sections, ["code", "number"], "left")
    of_label = (
        F.when(F.col("ingested").isNull(), "unknown act code").when(~F.col("ingested"), "act not ingested").when(F.col("text").isNull(), "section missing")
        .when(F.col("repealed"), "repealed").when(F.trim("text") == "", "empty text").when(F.col("phrase").isNotNull() & ~F.contains(F.lower("text"), F.lower("phrase")), "expected phrase lost")
    )
    return whole.unionByName(each.select("id", "label", of_label.alias("issue"))).where("issue is not null")


def integrity(gold: DataFrame) -> DataFrame:
    """duplicates, n_slices, share of unanswerable, labels that disagree with answerable."""
    ids = gold.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    n = F.size("labels") > 0
    # both are one row
    return gold.agg(F.count_distinct("slice").alias("n_slices"), ratio(F.count_if(~F.col("answerable")), F.count("*")).alias("unanswerable_share"), F.count_if(n != F.col("answerable")).alias("disagreeing")).join(ids)


def retrieval(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, slice, pos: where among the distinct numbers of hits (qid, rank, number) the first target of gold (qid, slice, number) stands; null: nowhere."""
    first = hits.groupBy("qid", "number").agg(F.min("rank").alias("r"))
    ranked = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("r")))
    found = ranked.join(gold.select("qid", "number").distinct(), ["qid", "number"]).groupBy("qid").agg(F.min("pos").alias("pos"))
    return gold.select("qid", "slice").distinct().join(found, "qid", "left")


def crossing(hits: DataFrame, gold: DataFrame, sections: DataFrame, windows: DataFrame, depth: int = 10, bucket: int = 4096) -> DataFrame:
    """slice, questions, hits, crossing: of gold (qid, slice, number), questions with a target among the first depth hits (qid, rank, act, i), and those where such a hit's window meets several sections.

    windows: act, i, begin, length. sections: act, number, start, end in the act's joined text. A hit is of the section that its first character is in, else of the last one before it.
    Windows and sections meet by the stretches of bucket characters that both lie in, so an act of any length is spread over its stretches.
    """
    first = hits.where(F.col("rank") <= depth).select("qid", "rank", "act", "i").join(windows.select("act", "i", "begin", (F.col("begin") + F.col("length")).alias("stop")), ["act", "i"])
    wanted = first.select("act", "i", "begin", "stop").distinct()
    stretches = lambda low, high: F.explode(F.sequence(F.floor(low / bucket), F.floor((high - 1) / bucket)))
    spread = sections.where("end > start").select("act", "number", "start", "end", stretches(F.col("start"), F.col("end")).alias("stretch"))
    met = wanted.select("*", stretches(F.col("begin"), F.col("stop")).alias("stretch")).join(spread, ["act", "stretch"]).where((F.col("start") < F.col("stop")) & (F.col("end") > F.col("begin")))
    # a section counts once, however many stretches it shares with the window
    facts = met.groupBy("act", "i").agg(F.count_distinct("start").alias("sections"), F.min_by("number", "start").alias("number"))
    right = first.join(facts, ["act", "i"]).join(gold.select("qid", "number").distinct(), ["qid", "number"])
    found = right.groupBy("qid").agg(F.bool_or(F.col("sections") > 1).alias("crosses"))
    each = gold.select("qid", "slice").distinct().join(found, "qid", "left")
    return each.groupBy("slice").agg(F.count("*").alias("questions"), F.count("crosses").alias("hits"), F.count_if(F.coalesce("crosses", F.lit(False))).alias("crossing"))


def recall(found: DataFrame, cuts: tuple[int, ...] = CUTS) -> list[Column]:
    return [ratio(F.count_if(F.col("pos") <= c), F.count("*")).alias(f"recall_{c}") for c in cuts]


def misses(found: DataFrame, hits: DataFrame, k: int = 10, show: int = 5) -> DataFrame:
    """qid, slice, first: questions without a target among k distinct numbers, and the first numbers that came instead."""
    gone = found.where(F.col("pos").isNull() | (F.col("pos") > k)).select("qid", "slice")
    top = hits.where(F.col("rank") <= show).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "number"))), lambda x: x["number"]).alias("first"))
    return gone.join(top, "qid", "left")


def selected(gold: DataFrame, slices: list[str], known: set[str], limit: int | None = None) -> DataFrame:
    """Gold of the slices, the first limit in file order. An unknown slice is an error."""
    if unknown := set(slices) - known:
        raise ValueError(f"unknown slices: {sorted(unknown)}")
    rows = gold.where(F.col("slice").isin(slices)) if slices else gold
    return rows.orderBy("ord").limit(limit) if limit else rows


def delta(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """metric, before, after, changed of two summaries of one row."""
    wide = lambda df: df.select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], names, "metric", "value")
    both = wide(before).withColumnRenamed("value", "before").join(wide(after).withColumnRenamed("value", "after"), "metric", "full_outer")
    return both.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def missing_answers(gold: DataFrame, answers: DataFrame) -> DataFrame:
    return gold.join(answers.select("qid").distinct(), "qid", "left_anti").agg(F.count("*").alias("missing_answers"))
