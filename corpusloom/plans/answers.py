"""Queries of replies, citations, scores, reports and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate, gate, quotes, reports, state
from corpusloom.plans.catalogue import CANON, RECALL, _top, query, table
from corpusloom.sources.scratch import bucketed, dropped

REPLY = """CASE WHEN event_id % 5 = 0 THEN ' no braces ' WHEN event_id % 5 = 1 THEN 'x {"answer": broken} y' ELSE 'Sure: {"answer": " a' || event_id || ' ", "citations": [{"section": " ' || event_id % 90 || '", "quote": "q"}, "12(a)", {"section": " "}], "refused": ' || CASE WHEN event_id % 5 = 2 THEN 'true' ELSE 'false' END || '} bye' END"""


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no braces' WHEN event_id % 5 = 1 THEN 'x {"answer": broken} y' ELSE 'a' || event_id END AS answer,
(CASE WHEN event_id % 5 < 2 THEN 0 ELSE 2 END)::BIGINT AS n_citations, CASE WHEN event_id % 5 < 2 THEN '' ELSE event_id % 90 || '/q/CrPC,12(a)//CrPC' END AS cited, event_id % 5 = 2 AS refused FROM events""")
def q30_reply_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", gate.replies(F.expr(REPLY)).alias("r"))
    cited = F.array_join(F.transform("r.citations", lambda c: F.concat_ws("/", c["section"], c["quote"], c["source"])), ",")
    return rows.select("event_id", "r.answer", F.size("r.citations").cast("long").alias("n_citations"), cited.alias("cited"), "r.refused")


RAW = """CASE event_id % 7 WHEN 0 THEN 'section ' || event_id || '(1)(b)' WHEN 1 THEN 'CrPC-' || event_id WHEN 2 THEN event_id || ' - i' WHEN 3 THEN event_id || ' a' WHEN 4 THEN 'none' WHEN 5 THEN '(' || event_id || ')' ELSE 's. ' || event_id || ' and ' || event_id END"""


@query(rf"""WITH r AS (SELECT event_id, event_type, {RAW} AS raw FROM events)
SELECT event_id, nullif(upper(regexp_replace(regexp_extract(string_split(raw, '(')[1], '(?i)\d+\s*-?\s*[A-Z]{{0,3}}'), '\s+', '', 'g')), '') AS number,
CASE WHEN event_type = 'view' THEN 'ScheduleII' WHEN event_type = 'click' THEN 'Uploaded' WHEN event_type = 'signup' THEN 'PenalCode' ELSE 'CrPC' END AS document FROM r""")
def q31_citation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "view", "Schedule II of the Code").when(kind == "click", "the uploaded file").when(kind == "signup", "PENAL code").otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", T.section_number(F.expr(RAW)).alias("number"), T.source_code(source).alias("document"))


# A citation of each document: of itself, of one that isn't there, of none; with its own words, invented ones or few.
CITED = """SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN 'none' WHEN doc_id % 9 = 1 THEN 'section ' || (doc_id + 100000000) ELSE 's. ' || doc_id END AS section,
CASE WHEN doc_id % 9 = 2 THEN 'penal code' ELSE '' END AS source, CASE WHEN doc_id % 4 = 0 THEN 'words that no document of the corpus holds' WHEN doc_id % 4 = 1 THEN 'few' ELSE {sub}(text, 1, 60) END AS quote FROM documents"""
GATED = (
    f"""WITH c AS ({CITED.format(sub='substr')}), b AS (SELECT doc_id, {CANON.format(x='text')} AS body FROM documents), k AS (SELECT c.doc_id AS qid, lang, {CANON.format(x='quote')} AS q, body, c.doc_id,
CASE WHEN c.doc_id % 9 = 0 THEN 'unparseable section reference' WHEN c.doc_id % 9 = 2 THEN 'PenalCode is not part of the ingested corpus' WHEN c.doc_id % 9 = 1 THEN 'no section ' || (c.doc_id + 100000000) || ' in the CrPC' WHEN c.doc_id % 9 = 3 THEN 'not present in the retrieved context' END AS bad FROM c JOIN b ON b.doc_id = c.doc_id),
g AS (SELECT qid, lang, bad IS NULL AS kept, coalesce(bad, CASE WHEN length(q) >= 20 AND NOT contains(body, q) THEN 'quoted text does not appear in the section' END) AS reason, coalesce(bad IS NULL AND length(q) >= 20 AND contains(body, q), false) AS verified FROM k)
"""
)


def columns(select: str) -> list[str]:
    """The expressions between SELECT and the last FROM of a statement."""
    body, found, depth, at = select[select.index("SELECT ") + 7 : select.rindex(" FROM ")], [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            found.append(body[at:i])
            at = i + 1
    return [x.strip() for x in (*found, body[at:])]


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "documents").selectExpr(*columns(CITED.format(sub="substr"))).withColumn("qid", F.col("doc_id")).withColumn("ord", F.lit(0))
    sources = table(spark, sf_dir, "documents").select(F.lit("CrPC").alias("document"), F.col("doc_id").cast("string").alias("number"), F.col("text").alias("body"), F.lit("").alias("note"))
    allowed = cited.select("qid", F.concat(F.lit("CrPC:"), F.when(F.col("doc_id") % 9 == 3, F.lit(-1)).otherwise(F.col("doc_id"))).alias("identifier"))
    return gate.gate(cited.select("qid", "ord", "lang", "section", "source", "quote"), sources, allowed.unionByName(cited.where("doc_id % 9 = 1").select("qid", F.lit("CrPC:1").alias("identifier"))))


@query(GATED + "SELECT qid, kept, reason, verified FROM g")
def q32_citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("qid", "kept", "reason", "verified")


@query(GATED + "SELECT qid, NOT kept AS refused, CASE WHEN NOT kept THEN 'No citation in the answer could be verified against the retrieved statutory text, so the answer was withheld.' END AS reason FROM g")
def q32_withheld_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.lit("an answer").alias("answer"), F.lit(False).alias("refused"))
    return gate.answered(asked, _gated(spark, sf_dir)).select("qid", "refused", "reason")


@query(GATED + "SELECT lang AS qid, count(*) FILTER (kept) AS n, count(*) FILTER (verified) AS n_verified FROM g GROUP BY 1 HAVING count(*) FILTER (kept) > 0")
def q34_group_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.grouped(_gated(spark, sf_dir).withColumn("qid", F.col("lang")))
    return found.groupBy("qid").agg(F.count("*").alias("n"), F.sum("n_verified").alias("n_verified"))


# Quotations that need a repair, by the number of their document: as written, with a label, elided, drifting at the end, invented.
REPAIRED = """CASE doc_id % 5 WHEN 0 THEN {sub}(text, 1, 80) WHEN 1 THEN 'Section ' || doc_id % 900 || '. ' || {sub}(text, 1, 80) WHEN 2 THEN {sub}(text, 1, 60) || ' ... ' || {sub}(text, 101, 60) WHEN 3 THEN {sub}(text, 1, 120) || ' zzzqqq invented at the end' ELSE 'zzzqqq ' || {sub}(text, 1, 90) END"""


@query()
def q33_quote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", quotes.checked(F.expr(REPAIRED.format(sub="substr")), F.col("text"), F.lit("")).alias("x"))
    return rows.select("doc_id", "x.verified", "x.repair", F.sha2("x.display", 256).alias("display_sha"))


# Failed quotations of every twentieth document: its next one's words, its own cut too short or turned round, invented ones.
FAILED = """CASE (doc_id // 20) % 4 WHEN 0 THEN {later} WHEN 1 THEN {sub}(c, 41, 9) || ' ... ' || {sub}(c, 81, 12) WHEN 2 THEN {sub}(c, 121, 40) || ' ... ' || {sub}(c, 1, 40) ELSE 'zzzqqq no such words anywhere xxxyyy' END"""


@query(
    f"""WITH b AS (SELECT doc_id, {CANON.format(x='text')} AS c FROM documents), o AS (SELECT *, lead(c) OVER (ORDER BY doc_id) AS later FROM b),
q AS (SELECT doc_id, c, (doc_id // 20) % 4 AS kind, substr(coalesce(later, ''), 11, 80) AS quote FROM o WHERE doc_id % 20 = 0), n AS (SELECT *, {CANON.format(x='quote')} AS needle FROM q)
SELECT n.doc_id AS item_id, CASE WHEN kind = 0 AND length(needle) >= 20 AND (SELECT min(doc_id) FROM b WHERE contains(b.c, needle)) IS NOT NULL THEN 'misattributed' WHEN kind IN (0, 3) THEN 'fabricated' ELSE NULL END AS verdict,
CASE WHEN kind = 0 AND length(needle) >= 20 THEN (SELECT min(doc_id) FROM b WHERE contains(b.c, needle)) END AS source FROM n WHERE kind IN (0, 3)"""
)
def q35_failure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("(item_id div 20) % 4 IN (0, 3)")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = bucketed(table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("c")), "canonical", "doc_id")
    heads = docs.select("doc_id", F.substring("c", 1, 170).alias("c"))
    # the next document of a block of ids, and of the first of the blocks behind, without one window over all
    block = F.floor(F.col("doc_id") / 4096)
    inner = heads.withColumn("later", F.lead("c").over(Window.partitionBy(block).orderBy("doc_id")))
    firsts = heads.groupBy(block.alias("block")).agg(F.min_by("c", "doc_id").alias("head"))
    firsts = firsts.withColumn("before", F.lag("block").over(Window.partitionBy(F.lit(0)).orderBy("block")))  # a row for each block
    rows = inner.withColumn("block", block).join(firsts.select(F.col("before").alias("block"), "head"), "block", "left").withColumn("later", F.coalesce("later", "head", F.lit("")))
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("item_id"), F.expr(FAILED.format(sub="substr", later="substr(later, 11, 80)").replace("//", " div ")).alias("quote"), F.col("doc_id").alias("cited"))
    found = quotes.explained(asked, docs, ready=True)
    dropped(docs)
    return found


@query()
def q35_all_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(RECALL + "SELECT qid, coalesce(pos <= 8, false) AS hit FROM h")
def q37_retrieval_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[0].select("qid", F.coalesce(F.col("pos") <= 8, F.lit(False)).alias("hit"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("number"))
    hits = _top(spark, sf_dir, 21).where("vec_id <> qid").join(labels, "vec_id").select("qid", "rank", "number")
    gold = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), (F.col("vec_id") % 3).cast("string").alias("slice"), "number")
    return evaluate.retrieval(hits, gold), hits


@query(RECALL + "SELECT (qid % 3)::VARCHAR AS slice, round(count(*) FILTER (pos <= 1)::DOUBLE / count(*), 4) AS recall_1, round(count(*) FILTER (pos <= 5)::DOUBLE / count(*), 4) AS recall_5, round(count(*) FILTER (pos <= 10)::DOUBLE / count(*), 4) AS recall_10 FROM h GROUP BY 1")
def q42_recall_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _found(spark, sf_dir)
    return found.groupBy("slice").agg(*evaluate.recall(found, (1, 5, 10)))


@query(RECALL + "SELECT h.qid, (h.qid % 3)::VARCHAR AS slice FROM h WHERE coalesce(pos, 99) > 2")
def q42_recall_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, hits = _found(spark, sf_dir)
    return evaluate.misses(found, hits, k=2).select("qid", "slice")


ROWS = """SELECT doc_id AS qid, lang, source, CASE WHEN n_chars < 60 THEN 'empty' END AS error, n_chars > 2000 AS refused, quality = 1 AS answerable, n_chars % 4 AS made, least(n_chars % 4, doc_id % 4) AS existing, least(n_chars % 4, doc_id % 4, doc_id % 3) AS correct,
n_chars % 6 AS checked, least(n_chars % 6, doc_id % 5) AS valid, least(n_chars % 6, doc_id % 5, doc_id % 2) AS repaired, greatest(0, n_chars % 6 - doc_id % 5) AS misattributed, doc_id % 2 AS fabricated, doc_id % 3 AS overelided, doc_id % 7 AS recomposed, doc_id % 9 AS retrieved, toxic = 0 AS retrieval_hit FROM labels JOIN documents USING (doc_id)"""
_R = "round({n}::DOUBLE / nullif({d}, 0), 4)"


def _rates() -> str:
    s = lambda c, w="m": f"coalesce(sum({c}) FILTER ({w}), 0)"
    n = lambda w: f"count(*) FILTER ({w})"
    r = lambda a, b: _R.format(n=f"({a})", d=f"({b})")
    return f"""count(*) AS questions, {n('m')} AS measured_n, {n('NOT m')} AS errors, {s('made')}::BIGINT AS citations_made, {r(s('existing'), s('made'))} AS citation_existence, round(1 - {s('existing')}::DOUBLE / nullif({s('made')}, 0), 4) AS hallucinated_citation_rate,
{r(s('correct', 'm AND answerable'), s('made', 'm AND answerable'))} AS citation_precision, {r(n('m AND answerable AND correct > 0'), n('m AND answerable'))} AS answer_hit_rate, CASE WHEN {s('retrieved')} > 0 THEN {r(n('m AND answerable AND retrieval_hit'), n('m AND answerable'))} END AS retrieval_recall,
{r(s('valid'), s('checked'))} AS excerpt_validity, {r(s('valid') + ' - ' + s('repaired'), s('checked'))} AS excerpt_validity_unrepaired, {r(s('misattributed'), s('checked'))} AS misattribution_rate, {r(s('fabricated'), s('checked'))} AS fabrication_rate, {r(s('overelided'), s('checked'))} AS overelision_rate, {r(s('recomposed'), s('checked'))} AS recomposition_rate,
{s('checked')}::BIGINT AS quotes_checked, {s('repaired')}::BIGINT AS quotes_repaired, {s('misattributed')}::BIGINT AS quotes_misattributed, {s('fabricated')}::BIGINT AS quotes_fabricated, {s('overelided')}::BIGINT AS quotes_overelided, {s('recomposed')}::BIGINT AS quotes_recomposed,
{r(n('m AND refused <> answerable'), n('m'))} AS refusal_accuracy, {r(n('m AND NOT answerable AND refused'), n('m AND NOT answerable'))} AS refused_when_unanswerable, {r(n('m AND answerable AND refused'), n('m AND answerable'))} AS refused_when_answerable"""


SCORED = f"WITH r AS (SELECT *, error IS NULL AS m FROM ({ROWS}))\n"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return evaluate.predicates(both.selectExpr(*columns(ROWS)))


@query(SCORED + f"SELECT {_rates()} FROM r")
def q38_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).agg(*evaluate.metrics())


@query(SCORED + f"SELECT lang, {_rates()} FROM r GROUP BY 1")
def q39_all_metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("lang").agg(*evaluate.metrics())


@query(
    """WITH g AS (SELECT l.doc_id AS id, quality = 1 AS answerable, CASE l.doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['XX-' || l.doc_id] WHEN 2 THEN ['EvidenceAct-' || l.doc_id] WHEN 3 THEN ['CrPC--' || l.doc_id] ELSE ['CrPC-' || l.doc_id] END::VARCHAR[] AS labels, 'the' AS phrase FROM labels l),
e AS (SELECT id, phrase, unnest(labels) AS label FROM g), j AS (SELECT e.*, d.doc_id, d.text FROM e LEFT JOIN documents d ON e.label = 'CrPC-' || d.doc_id)
SELECT id, NULL::VARCHAR AS label, CASE WHEN answerable AND len(labels) = 0 THEN 'answerable without labels' ELSE 'unanswerable with labels' END AS issue FROM g WHERE answerable = (len(labels) = 0)
UNION ALL SELECT * FROM (SELECT id, label, CASE WHEN label LIKE 'XX-%' THEN 'unknown act code' WHEN label LIKE 'EvidenceAct-%' THEN 'act not ingested' WHEN doc_id IS NULL THEN 'section missing' WHEN doc_id % 7 = 0 THEN 'repealed' WHEN trim(text) = '' THEN 'empty text' WHEN NOT contains(lower(text), 'the') THEN 'expected phrase lost' END AS issue FROM j) WHERE issue IS NOT NULL"""
)
def q40_gold_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 6
    label = F.when(i == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.when(i == 1, "XX-").when(i == 2, "EvidenceAct-").when(i == 3, "CrPC--").otherwise("CrPC-"), F.col("doc_id").cast("string"))))
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answerable"), label.alias("labels"), F.lit("the").alias("phrase"))
    acts = spark.createDataFrame([("CrPC", True), ("EvidenceAct", False)], "code string, ingested boolean")
    sections = table(spark, sf_dir, "documents").select(F.lit("CrPC").alias("code"), F.col("doc_id").cast("string").alias("number"), (F.col("doc_id") % 7 == 0).alias("repealed"), "text")
    return evaluate.gold_issues(gold, acts, sections)


DELTA = ["refusal_accuracy", "answer_hit_rate", "excerpt_validity", "errors"]


@query(
    SCORED
    + f", a AS (SELECT {_rates()} FROM r), b AS (SELECT {_rates()} FROM r WHERE qid % 2 = 0)\n"
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, a.{n}::DOUBLE AS before, b.{n}::DOUBLE AS after, a.{n}::DOUBLE IS DISTINCT FROM b.{n}::DOUBLE AS changed FROM a, b" for n in DELTA)
)
def q43_rescore_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return evaluate.delta(rows.agg(*evaluate.metrics()), rows.where("qid % 2 = 0").agg(*evaluate.metrics()), DELTA)


PCT = ["citation_precision", "answer_hit_rate", "excerpt_validity"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rows(spark, sf_dir).groupBy(F.col("lang").alias("model"), F.col("source").alias("stage")).agg(*evaluate.metrics())
    return found.withColumnRenamed("measured_n", "measured").withColumns({"dataset_questions": F.col("questions") + 3, "missing_answers": F.col("errors")})


@query(
    SCORED
    + f", g AS (SELECT lang AS model, source AS stage, {_rates()} FROM r GROUP BY 1, 2)\nSELECT model, stage, row_number() OVER (PARTITION BY model ORDER BY stage) AS place, measured_n || '/' || questions || CASE WHEN errors > 0 THEN ' of ' || (questions + 3) ELSE '' END AS covered, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE printf('%.1f%%', {c} * 100) END AS {c}" for c in PCT)
    + " FROM g"
)
def q44_report_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_model(_runs(spark, sf_dir), PCT)


@query(SCORED + f", g AS (SELECT lang AS model, source AS stage, {_rates()} FROM r GROUP BY 1, 2)\n" + " UNION ALL ".join(f"SELECT model, stage, '{c}' AS metric, {c} AS value FROM g" for c in PCT))
def q45_metric_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_form(_runs(spark, sf_dir), PCT)


@query()
def q47_lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor(F.coalesce("value", F.lit(0.0)) / 10).cast("long").alias("v"))
    return state.cached(events, 8)


MESSAGE = """CASE event_id % 6 WHEN 0 THEN 'Rate limit: try again in ' || event_id % 3 || 'h' || event_id % 50 || 'm' || event_id % 59 || '.5s.' WHEN 1 THEN 'try again in ' || event_id % 1000 || 's' WHEN 2 THEN 'Try again in 5s' WHEN 3 THEN 'tokens per day reached, try again in 2m' WHEN 4 THEN 'Connection reset' ELSE event_type END"""


@query(
    rf"""WITH e AS (SELECT event_id, {MESSAGE} AS m FROM events), x AS (SELECT *, regexp_extract(m, 'try again in ([0-9hms.]+)', 1) AS t FROM e),
u AS (SELECT *, coalesce(TRY_CAST(regexp_extract(t, '([0-9.]+)h', 1) AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(t, '([0-9.]+)m', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(t, '([0-9.]+)s', 1) AS DOUBLE), 0) AS s FROM x)
SELECT event_id, CASE WHEN t = '' THEN 600.0::DOUBLE ELSE least(1800, greatest(30, s + 15)) END AS seconds, (CASE WHEN m LIKE 'tokens per day%' OR lower(m) LIKE '%connection%' THEN 503 ELSE 502 END)::INT AS status FROM u"""
)
def q49_retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr(MESSAGE)
    return table(spark, sf_dir, "events").select("event_id", T.retry_seconds(m).alias("seconds"), T.failure_status(m).alias("status"))
