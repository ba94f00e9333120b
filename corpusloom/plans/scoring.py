"""Queries of quotations, scores, re-scoring, retrieval across sections and events, whose SQL computes what the operators do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks, evaluate, quotes, state
from corpusloom.plans import answers, catalogue
from corpusloom.plans.catalogue import CANON, query, table
from corpusloom.sources.scratch import written

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
ELLIPSIS = r"\s*(?:\.\s*\.\s*\.|…)\s*"
PIECES = rf"list_filter(list_transform(regexp_split_to_array({{x}}, '{ELLIPSIS}'), lambda p: trim({CANON.format(x='p')}, ' ,;:.')), lambda p: p <> '')"
ORDERED = "list_reduce({x}, lambda rest, f: CASE WHEN strpos(rest, f) = 0 THEN NULL ELSE substr(rest, strpos(rest, f) + length(f)) END, {c}) IS NOT NULL"
STANDS = f"CASE WHEN len({{p}}) < 2 THEN CASE WHEN contains(c, {{f}}) THEN '' END WHEN list_min(list_transform({{p}}, lambda x: length(x))) >= 20 AND {ORDERED.format(x='{p}', c='c')} THEN 'elision' END"
HEAD = r"^(?:(?:section )?\d+ ?-? ?[a-z]{0,3} ?[.\-—:] ?[ .:\-—]*){1,2}"
RAW_HEAD = r"(?i)^(?:\s*(?:section\s+)?\d+\s*-?\s*[a-z]{0,3}\s*[.\-—:]\s*[ .:\-—]*){1,2}"

# Of quotations asked(id, quote, c), c the canonical body that each cites: how it verifies, null where it doesn't.
CHECKED = rf"""w AS (SELECT *, {STRIP.format(x='quote')} AS said FROM asked), f AS (SELECT *, {CANON.format(x='said')} AS form FROM w),
g AS (SELECT *, regexp_replace(form, '{HEAD}', '') AS bare FROM f),
h AS (SELECT *, {PIECES.format(x='said')} AS fs, {PIECES.format(x='bare')} AS bs, coalesce(list_max(list_filter(range(1, length(form) + 1), lambda k: contains(c, substr(form, 1, k::BIGINT)))), 0) AS opening FROM g),
s AS (SELECT *, {STANDS.format(p='fs', f='form')} AS s1, CASE WHEN bare <> form AND length(bare) >= 20 THEN {STANDS.format(p='bs', f='bare')} END AS s2 FROM h),
checked AS (SELECT *, CASE WHEN length(form) < 20 OR c = '' THEN NULL WHEN s1 IS NOT NULL THEN s1 WHEN s2 IS NOT NULL THEN 'label' || CASE WHEN s2 <> '' THEN '+' || s2 ELSE '' END WHEN opening >= 20 AND opening >= 0.5 * length(form) THEN 'trimmed' END AS repair FROM s)"""

# Of failed(id, fs, form, c) and bodies b(doc_id, c): why each failed, and the first source of a misattributed one.
EXPLAINED = f"""own AS (SELECT id, fs, form, len(fs) > 1 AS many, len(list_filter(fs, lambda p: NOT contains(coalesce(c, ''), p))) = 0 AS inside, {ORDERED.format(x='fs', c='c')} AS ordered FROM failed),
one AS (SELECT id, min(doc_id) AS source FROM own JOIN b ON NOT many AND length(form) >= 20 AND contains(b.c, form) GROUP BY 1),
several AS (SELECT id, min(doc_id) AS source FROM own JOIN b ON many AND NOT inside AND list_min(list_transform(fs, lambda x: length(x))) >= 20 AND contains(b.c, fs[1]) AND {ORDERED.format(x='fs', c='b.c')} GROUP BY 1),
piece AS (SELECT DISTINCT p FROM (SELECT unnest(fs) AS p FROM own WHERE many AND NOT inside)), known AS (SELECT p FROM piece WHERE EXISTS (SELECT 1 FROM b WHERE contains(b.c, p))),
all_known AS (SELECT id, bool_and(known.p IS NOT NULL) AS every FROM (SELECT id, unnest(fs) AS p FROM own WHERE many AND NOT inside) x LEFT JOIN known USING (p) GROUP BY 1),
explained AS (SELECT own.id, CASE WHEN many AND inside THEN CASE WHEN ordered THEN 'overelided' ELSE 'recomposed' END WHEN coalesce(one.source, several.source) IS NOT NULL THEN 'misattributed' WHEN many AND every THEN 'recomposed' ELSE 'fabricated' END AS verdict,
CASE WHEN NOT (many AND inside) THEN coalesce(one.source, several.source) END AS source FROM own LEFT JOIN one USING (id) LEFT JOIN several USING (id) LEFT JOIN all_known USING (id))"""


catalogue.given("q33_quote_repair", f"""WITH asked AS (SELECT doc_id AS id, {answers.REPAIRED.format(sub='substr')} AS quote, {CANON.format(x='text')} AS c FROM documents), {CHECKED}
SELECT id AS doc_id, repair IS NOT NULL AS verified, coalesce(repair, '') AS repair, sha256(CASE WHEN repair IS NULL THEN '' WHEN repair IN ('', 'elision') THEN said WHEN repair LIKE 'label%' THEN {STRIP.format(x=f"regexp_replace(said, '{RAW_HEAD}', '')")}
ELSE {STRIP.format(x=f"substr(said, 1, list_max(list_filter(range(1, length(said) + 1), lambda k: length({CANON.format(x='substr(said, 1, k::BIGINT)')}) <= opening))::BIGINT)")} END) AS display_sha FROM checked""")  # fmt: skip

catalogue.given("q35_all_verdicts", f"""WITH b AS (SELECT doc_id, {CANON.format(x='text')} AS c FROM documents), o AS (SELECT *, lead(c) OVER (ORDER BY doc_id) AS next FROM b),
q AS (SELECT doc_id AS id, c, {answers.FAILED.format(sub='substr', later="substr(coalesce(next, ''), 11, 80)")} AS quote FROM o WHERE doc_id % 20 = 0),
failed AS (SELECT id, {PIECES.format(x='quote')} AS fs, {CANON.format(x='quote')} AS form, c FROM q), {EXPLAINED}
SELECT id AS item_id, verdict, source FROM explained""")  # fmt: skip


# Answers of labelled documents with eight citations each: own words, those of a benchmark item, a section that isn't there, pieces turned round, pieces too
# short, invented words, a label before own words, own words that drift.
_OF = "FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"
CITES = f"""SELECT l.doc_id AS qid, 0 AS ord, 's. ' || l.doc_id AS section, substr(d.text, 1, 60) AS quote {_OF}
UNION ALL SELECT l.doc_id, 1, 'Section ' || l.doc_id, substr(b.text, 1, 80) FROM {{labels}} l JOIN {{benchmark}} b ON b.item_id = l.doc_id % 40
UNION ALL SELECT l.doc_id, 2, 'no. ' || (l.doc_id + 100000000) || '(2)', 'words of a section that is not there' FROM {{labels}} l
UNION ALL SELECT l.doc_id, 3, 's. ' || l.doc_id, substr(d.text, 81, 40) || ' ... ' || substr(d.text, 1, 40) {_OF}
UNION ALL SELECT l.doc_id, 4, 's. ' || l.doc_id, substr(d.text, 1, 12) || ' ... ' || substr(d.text, 101, 12) || ' ... ' || substr(d.text, 201, 12) {_OF}
UNION ALL SELECT l.doc_id, 5, 's. ' || l.doc_id, 'zzzqqq no such words stand anywhere xxxyyy' FROM {{labels}} l WHERE l.doc_id % 3 = 0
UNION ALL SELECT l.doc_id, 6, 's. ' || l.doc_id, '12. ' || substr(d.text, 1, 70) {_OF}
UNION ALL SELECT l.doc_id, 7, 's. ' || l.doc_id, substr(d.text, 1, 90) || ' and then words that are not there' {_OF}"""
SAID = "SELECT doc_id AS qid, toxic = 1 AS refused, CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS error, {array}('CrPC:' || CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 1 END) AS retrieved FROM {labels}"
TARGETS = "SELECT doc_id AS qid, quality = 1 AS answerable, CASE WHEN quality = 1 THEN {array}('CrPC:' || doc_id) ELSE {none} END AS targets FROM {labels}"


def _scored_sql(text: str) -> str:
    names = {t: t for t in ("labels", "documents", "benchmark")} | {"array": "list_value", "none": "[]::VARCHAR[]"}
    count = lambda v: f"count(*) FILTER (error IS NULL AND checked AND verdict = '{v}') AS {v}"
    return f"""WITH b AS (SELECT doc_id, {CANON.format(x=text)} AS c FROM documents), ci AS ({CITES.format(**names)}), said AS ({SAID.format(**names)}), gold AS ({TARGETS.format(**names)}),
asked AS (SELECT qid * 10 + ord AS id, qid, quote, coalesce(b.c, '') AS c, coalesce(b.c, '') <> '' AS there FROM ci LEFT JOIN b ON ci.ord <> 2 AND b.doc_id = ci.qid), {CHECKED},
rated AS (SELECT *, there AND length(form) >= 20 AS checked FROM checked), failed AS (SELECT id, fs, form, c FROM rated WHERE checked AND repair IS NULL), {EXPLAINED},
j AS (SELECT rated.qid, rated.there, rated.checked, rated.repair, explained.verdict, said.error, gold.answerable FROM rated LEFT JOIN explained USING (id) JOIN said USING (qid) JOIN gold USING (qid)),
n AS (SELECT qid, count(*) FILTER (error IS NULL) AS made, count(*) FILTER (error IS NULL AND there) AS existing, count(*) FILTER (error IS NULL AND there AND answerable) AS correct, count(*) FILTER (error IS NULL AND checked) AS checked,
count(*) FILTER (error IS NULL AND checked AND repair IS NOT NULL) AS valid, count(*) FILTER (error IS NULL AND checked AND repair <> '') AS repaired, {', '.join(map(count, ('misattributed', 'fabricated', 'overelided', 'recomposed')))} FROM j GROUP BY 1)
SELECT n.*, CASE WHEN error IS NULL THEN 1 ELSE 0 END::BIGINT AS retrieved, error IS NULL AND answerable AND (qid % 2 = 0 OR qid = 1) AS retrieval_hit, error IS NULL AS measured, error IS NULL AND refused <> answerable AS decided_correctly, correct > 0 AS has_correct_citation FROM n JOIN said USING (qid) JOIN gold USING (qid)"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, citations and gold."""
    tables = {t: table(spark, sf_dir, t) for t in ("labels", "documents", "benchmark")}
    # citations quote from the first 212 characters of texts: these meet the labels, not the whole texts; merged, as labels are many times their files' size in a broadcast
    tables["documents"] = tables["documents"].select("doc_id", F.substring("text", 1, 212).alias("text")).hint("merge")
    frame = lambda sql: spark.sql(sql.replace("{array}", "array").replace("{none}", "CAST(array() AS array<string>)"), **{t: d for t, d in tables.items() if f"{{{t}}}" in sql})
    return frame(SAID), frame(CITES).withColumn("source", F.lit("")), frame(TARGETS)


def _sources(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    body = F.col("text") if text is None else text
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lit("CrPC").alias("document"), F.col("doc_id").cast("string").alias("number"), body.alias("body"), F.lit("").alias("note"))


SCORE = ["qid", *evaluate.COUNTS, "retrieval_hit", "measured", "decided_correctly", "has_correct_citation"]


@query(_scored_sql("text"))
def q36_scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, cited, gold = _run(spark, sf_dir)
    return evaluate.scored(said, evaluate.verified(cited, _sources(spark, sf_dir)), gold).select(*SCORE)


CHANGED = "CASE WHEN doc_id % 13 = 0 THEN reverse(text) ELSE text END"


@query(_scored_sql(CHANGED))
def q43_rescored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after every thirteenth source has changed, made anew only where something that they follow from has."""
    said, cited, gold = _run(spark, sf_dir)
    cited = written(cited, "citations")  # read four times
    stored, _ = evaluate.rescored(None, said, cited, gold, _sources(spark, sf_dir))
    return evaluate.rescored(stored, said, cited, gold, _sources(spark, sf_dir, F.expr(CHANGED)))[0].select(*SCORE)


@query(catalogue.WINDOWS + """, g AS (SELECT l.doc_id AS qid, d.lang AS slice, s.source, s.st, s.len FROM labels l JOIN documents d USING (doc_id) LEFT JOIN s ON s.doc_id = l.doc_id),
h AS (SELECT qid, r AS rank, source, st // 850 + r - 2 AS i FROM g, (SELECT unnest([1, 2, 3]) AS r) WHERE st IS NOT NULL),
m AS (SELECT h.qid, h.rank, x.source, x.i, count(*) AS sections, arg_min(s.doc_id, s.st) AS first FROM h JOIN x ON x.source = h.source AND x.i = h.i JOIN s ON s.source = x.source AND s.st < x.b + x.len AND s.st + s.len > x.b GROUP BY ALL),
f AS (SELECT qid, bool_or(sections > 1) AS crosses FROM m WHERE first = qid GROUP BY 1)
SELECT slice, count(*) AS questions, count(crosses) AS hits, count(*) FILTER (crosses) AS crossing FROM (SELECT DISTINCT qid, slice FROM g) LEFT JOIN f USING (qid) GROUP BY 1""")  # fmt: skip
def q42_crossing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = chunks.spans(docs, "source", "doc_id", "text")
    sections = placed.select(F.col("source").alias("act"), F.col("doc_id").cast("string").alias("number"), "start", "end")
    windows = chunks.windows(docs, "source", "doc_id", "text").select(F.col("source").alias("act"), "i", "begin", "length")
    gold = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("qid"), F.col("lang").alias("slice"), F.col("doc_id").cast("string").alias("number"))
    ranks = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")
    hits = placed.join(gold.select("qid"), F.col("doc_id") == F.col("qid")).select("qid", F.col("source").alias("act"), "start", ranks).withColumn("i", F.floor(F.col("start") / 850) + F.col("rank") - 2)
    return evaluate.crossing(hits, gold, sections, windows)


# Events of a user in order, and what a machine says to each, by recursion.
EVENTS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) AS t, {more} FROM events))"
DAY = 24 * 3600 * state.SECOND


def _limiter_sql(kind: str) -> str:
    live = f"list_filter(r.hits, lambda h: h > e.t - {DAY})"
    return f"""WITH RECURSIVE {EVENTS.format(more=kind + " AS kind")},
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS hits, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::BIGINT AS remaining, NULL::DOUBLE AS retry_after FROM e
UNION ALL SELECT e.user_id, e.n, CASE WHEN e.kind = 'forget' THEN list_slice(r.hits, 1, len(r.hits) - 1) WHEN len({live}) >= 3 THEN {live} ELSE list_append({live}, e.t) END, e.event_id, CASE WHEN e.kind = 'check' THEN len({live}) < 3 END,
CASE WHEN e.kind = 'forget' THEN 3 - greatest(0, len(r.hits) - 1) ELSE greatest(0, 2 - len({live})) END, CASE WHEN e.kind = 'check' THEN CASE WHEN len({live}) >= 3 THEN ({live}[1] + {DAY} - e.t) / 1e6 ELSE 0 END END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, allowed, remaining, retry_after FROM r WHERE n > 0"""


def _events(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *more)


catalogue.given("q46_sliding_limiter", _limiter_sql("'check'"))
_FORGET = "CASE WHEN event_type = 'error' THEN 'forget' ELSE 'check' END"


@query(_limiter_sql(_FORGET))
def q46_forget_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.limited(_events(spark, sf_dir, F.expr(_FORGET).alias("kind")), limit=3, window=24 * 3600)


def _bucket_sql(kind: str, amount: str, request: str) -> str:
    most = "7200.0::DOUBLE"
    return f"""WITH RECURSIVE {EVENTS.format(more=f"{kind} AS kind, {amount}::DOUBLE AS amount")}, q AS (SELECT *, {request} AS request FROM e),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, {most} AS level, NULL::DOUBLE AS clock, []::STRUCT(name VARCHAR, wish DOUBLE, since BIGINT)[] AS held, NULL::BIGINT AS event_id, NULL::DOUBLE AS available, NULL::DOUBLE AS waited FROM e
UNION ALL SELECT user_id, n, level, CASE WHEN kind = 'settle' THEN now ELSE later END, CASE WHEN kind = 'settle' THEN CASE WHEN back IS NULL THEN live ELSE list_filter(live, lambda x: x.name <> request) END WHEN request IS NULL THEN live ELSE list_append(live, struct_pack(name := request, wish := wish, since := trunc(later)::BIGINT)) END,
event_id, round(level, 4), CASE WHEN kind = 'reserve' THEN round((later - t) / 1e6, 4) END FROM (
SELECT *, CASE WHEN kind = 'settle' THEN CASE WHEN back IS NULL THEN full_ ELSE greatest(0.0, least({most}, full_ + back - amount)) END ELSE greatest(full_, wish) - wish END AS level, now + greatest(0.0, wish - full_) / {most} * 60e6 AS later FROM (
SELECT *, least(amount, {most}) AS wish, list_filter(live, lambda x: x.name = request)[1].wish AS back FROM (
SELECT *, CASE WHEN clock IS NULL THEN before ELSE least({most}, before + (now - clock) / 60e6 * {most}) END AS full_, list_filter(held, lambda x: x.since > now - 3600000000) AS live FROM (
SELECT q.*, r.level AS before, r.clock, r.held, CASE WHEN r.clock IS NULL THEN q.t::DOUBLE ELSE greatest(q.t::DOUBLE, r.clock) END AS now FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1)))))
SELECT event_id, available, waited FROM r WHERE n > 0"""


catalogue.given("q48_token_bucket", _bucket_sql("'reserve'", "event_id % 4000", "NULL::VARCHAR"))
_KIND, _AMOUNT = "CASE WHEN event_type IN ('purchase', 'error') THEN 'settle' ELSE 'reserve' END", "(event_id * 7 % 4000)"


@query(_bucket_sql(_KIND, _AMOUNT, "CASE WHEN kind = 'settle' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id) ELSE event_id END::VARCHAR"))
def q48_settle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations, and what the request before took in the end."""
    from pyspark.sql import Window

    rows = _events(spark, sf_dir, F.expr(_KIND).alias("kind"), F.expr(_AMOUNT).cast("double").alias("amount"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return state.bucket(rows.withColumn("request", F.when(F.col("kind") == "settle", before).otherwise(F.col("event_id")).cast("string")), per_minute=8000)


def _recent_sql(kind: str, value: str, size: int, columns: str) -> str:
    there, without = "list_contains(r.kept, e.v)", "list_filter(r.kept, lambda x: x <> e.v)"
    grown = f"list_append({without}, e.v)"
    return f"""WITH RECURSIVE {EVENTS.format(more=f"{kind} AS kind, {value} AS v")},
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::VARCHAR[] AS kept, 0::BIGINT AS hits, 0::BIGINT AS misses, NULL::BIGINT AS event_id, NULL::VARCHAR AS v, NULL::BOOLEAN AS hit, NULL::VARCHAR AS evicted FROM e
UNION ALL SELECT e.user_id, e.n, CASE WHEN {there} OR e.kind <> 'get' THEN list_slice({grown}, greatest(1, len({grown}) - {size} + 1), len({grown})) ELSE r.kept END, r.hits + CASE WHEN e.kind <> 'put' AND {there} THEN 1 ELSE 0 END, r.misses + CASE WHEN e.kind <> 'put' AND NOT {there} THEN 1 ELSE 0 END,
e.event_id, e.v, CASE WHEN e.kind <> 'put' THEN {there} END, CASE WHEN NOT {there} AND e.kind <> 'get' AND len(r.kept) >= {size} THEN r.kept[1] END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT {columns} FROM r WHERE n > 0"""


catalogue.given("q47_lru_cache", _recent_sql("'look'", "floor(coalesce(value, 0.0) / 10)::BIGINT::VARCHAR", 8, "event_id, hit"))
_PUT = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' ELSE 'get' END"


@query(_recent_sql(_PUT, "substr(sha256('file ' || floor(coalesce(value, 0.0) / 2)::BIGINT), 1, 16)", 6, "event_id, v AS document_id, hit, evicted, hits, misses"))
def q47_document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads and reads of files by content: equal files have one id."""
    content = F.concat(F.lit("file "), F.floor(F.coalesce("value", F.lit(0.0)) / 2).cast("long").cast("string"))
    rows = _events(spark, sf_dir, F.expr(_PUT).alias("kind"), content.alias("file"))
    rows = rows.withColumns({"content": F.when(F.col("kind") == "put", F.col("file").cast("binary")), "document_id": F.when(F.col("kind") == "get", state.document_id(F.col("file").cast("binary")))})
    return state.documents(rows, 6).select("event_id", "document_id", "hit", "evicted", "hits", "misses")


# Sub-sections packed by SQL: parts stand between marks of chr(1), finished pieces between marks of chr(2).
_OPEN = "list_last(string_split(done, chr(2)))"
PACKED = rf"""list_filter(list_transform(CASE WHEN length({{x}}) <= 1400 THEN [{{x}}] ELSE string_split(list_reduce(string_split(regexp_replace({{x}}, '(\(\d+\)|\([a-z]{{{{1,2}}}}\))', chr(1) || '\1', 'g'), chr(1)),
lambda done, part: CASE WHEN {_OPEN} <> '' AND length({_OPEN}) + length(part) > 1400 THEN done || chr(2) || part ELSE done || part END, ''), chr(2)) END, lambda p: trim(p)), lambda p: p <> '')"""
catalogue.given("q17_section_aware_chunks", f"""SELECT doc_id, (i - 1)::BIGINT AS piece, length(ps[i::BIGINT]) AS len, sha256(ps[i::BIGINT]) AS sha FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, {PACKED.format(x='text')} AS ps FROM documents))""")


_UNITS = " + ".join(f"coalesce(TRY_CAST(regexp_extract(t, '([0-9.]+){u}', 1) AS DOUBLE), 0) * {n}" for u, n in (("h", 3600), ("m", 60), ("s", 1)))


@query(f"""WITH e AS (SELECT event_id, event_id % 2 = 0 AS here, {answers.MESSAGE} AS m FROM events), x AS (SELECT *, regexp_extract(m, 'try again in ([0-9hms.]+)', 1) AS t FROM e), u AS (SELECT *, least(1800, greatest(30, {_UNITS} + 15)) AS s FROM x)
SELECT event_id, CASE WHEN m LIKE 'tokens per day%' THEN '{T.SPENT}' || CASE WHEN t <> '' THEN ' It frees up in about ' || greatest(1, floor(floor(s) / 60)::BIGINT) || ' minutes.' ELSE '' END || '{T.STILL}' || CASE WHEN here THEN '{T.SWITCH}' ELSE '{T.WAIT}' END
WHEN lower(m) LIKE '%connection%' THEN '{T.UNREACHED}' || m || CASE WHEN here THEN '{T.LOCAL}' ELSE '' END ELSE '{T.UNAVAILABLE}' || m END AS told FROM u""")  # fmt: skip
def q49_failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told of each failure."""
    m = F.expr(answers.MESSAGE)
    return table(spark, sf_dir, "events").select("event_id", T.failure_message(m, F.col("event_id") % 2 == 0).alias("told"))
