"""Queries of whole ways from a source to its relations: acts from markup, tables from positioned words, chunks of every strategy, vectors of a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import acts, chunks, index, tables
from corpusloom.plans.catalogue import query, table
from corpusloom.plans.parsing import NOTE
from corpusloom.plans.scoring import PACKED, STRIP

CLEAN = r"regexp_replace(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' +([,.;:)\]])', '\1', 'g'), '^\.\s*\(', '(')"
NUMBER = r"^\s*(\[\s*)?(\d+(?:-?[A-Z]{1,3})?)\s*\."


def _escaped(text: F.Column) -> F.Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _act_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as an act's page: a user's turn is a numbered section, what follows goes on with it, every third row has a footnote's marker."""
    said = F.when(F.col("role") == "user", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    marker = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('<span class="footnote">'), F.col("turn").cast("string"), F.lit("</span>"))).otherwise("")
    chapter = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('<div class="act-chapter-group">CHAPTER '), F.col("turn").cast("string"), F.lit("</div>"))).otherwise("")
    row = F.concat(F.lit('<div class="lineremoves">'), chapter, F.lit('<div class="txt-head">Note '), F.col("turn").cast("string"), F.lit('</div><div class="txt-details">'), _escaped(said), marker, F.lit("</div></div>"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("act_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    return rows.select("act_id", F.concat(F.lit("<html><h3>An Act</h3>"), "rows", F.lit("</html>")).alias("html"))


@query(rf"""WITH c AS (SELECT *, {CLEAN.format(x="CASE WHEN role = 'user' THEN (turn + 1) || '. ' || text ELSE text END")} AS t FROM conversations),
h AS (SELECT *, last_value(CASE WHEN turn % 4 = 0 THEN 'CHAPTER ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter, regexp_extract(t, '{NUMBER}', 2) AS number FROM c),
s AS (SELECT *, sum(CASE WHEN number <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM h WHERE t <> '')
SELECT conv_id AS act_id, ord::BIGINT AS ord, max(nullif(number, '')) AS number, arg_min(chapter, turn) AS chapter, count(*) AS n_units, string_agg('Note ' || turn, ',' ORDER BY turn) AS notes, coalesce(string_agg(CASE WHEN turn % 3 = 0 THEN turn::VARCHAR END, ',' ORDER BY turn), '') AS markers, sha256(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS content_hash FROM s WHERE ord > 0 GROUP BY 1, 2""")  # fmt: skip
def q50_act_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = acts.sections(acts.rows(_act_pages(spark, sf_dir)))
    return found.select("act_id", F.col("ord").cast("long").alias("ord"), "number", "chapter", F.size("units").cast("long").alias("n_units"), F.array_join("marginal_notes", ",").alias("notes"), F.array_join("footnote_markers", ",").alias("markers"), "content_hash")


@query(rf"""WITH n AS (SELECT o_custkey, o_orderkey, o_orderdate, {NOTE.format(month="monthname(o_orderdate)")} AS note, o_orderkey % 7 AS marker FROM orders),
l AS (SELECT o_custkey, marker, max(o_orderkey) AS o_orderkey FROM n GROUP BY 1, 2)
SELECT o_custkey AS act_id, marker::INT AS marker, CASE WHEN regexp_matches(note, '(?i)\brenumbered\b') THEN 'renumbered' WHEN regexp_matches(note, '(?i)\bsubstituted\b') THEN 'substituted' WHEN regexp_matches(note, '(?i)\binserted\b') THEN 'inserted'
WHEN regexp_matches(note, '(?i)\bomitted\b') THEN 'omitted' WHEN regexp_matches(note, '(?i)\brepealed\b') THEN 'repealed' WHEN regexp_matches(note, '(?i)\badded\b') THEN 'added' ELSE 'unknown' END AS operation,
'Act ' || o_orderkey AS amending_act_title, (o_orderkey % 500)::INT AS amending_act_id, regexp_extract(note, 'Act No\. ([^)]+)', 1) AS act_number, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS effective_from FROM l JOIN n USING (o_custkey, marker, o_orderkey)""")  # fmt: skip
def q51_act_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes of a page for each customer; a marker that comes again stands for its last note."""
    key = F.col("o_orderkey").cast("string")
    note = F.concat(F.lit('<li class="footnoteList"><sup>'), (F.col("o_orderkey") % 7).cast("string"), F.lit("</sup> "), F.expr(NOTE.format(month="date_format(o_orderdate, 'MMMM')")), F.lit(' <a href="/act-'), (F.col("o_orderkey") % 500).cast("string"), F.lit('.html">Act '), key, F.lit("</a></li>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("act_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", note.alias("row")))), lambda x: x["row"]), "").alias("html"))
    return acts.amendments(pages).select("act_id", "marker", "operation", "amending_act_title", "amending_act_id", "act_number", "effective_from")


# Orders as the rows of twenty tables over their pages: chapters, records, lines that go on with one, dittos.
LINES = """SELECT *, CASE kind WHEN 'chapter' THEN '' WHEN 'more' THEN '' ELSE (o_orderkey % 900 + 1) || '.' END AS c0, CASE kind WHEN 'chapter' THEN 'CHAPTER XV' WHEN 'more' THEN 'goes on' ELSE 'Offence ' || o_orderkey END AS c1,
CASE WHEN kind <> 'record' THEN '' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'May arrest' WHEN 1 THEN 'Ditto' WHEN 2 THEN 'Shall not arrest' WHEN 3 THEN 'ditto as above' ELSE '' END END AS c2, CASE WHEN kind <> 'record' THEN '' WHEN o_orderkey % 3 = 0 THEN 'Warrant' ELSE 'Ditto' END AS c3,
CASE WHEN kind <> 'record' THEN '' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'Bailable' WHEN 1 THEN 'Not bailable' WHEN 2 THEN 'Ditto' ELSE 'According as' END END AS c4, CASE WHEN kind = 'record' AND o_orderkey % 6 = 0 THEN 'Not compoundable' WHEN kind = 'record' THEN 'ditto' ELSE '' END AS c5, CASE WHEN kind = 'record' THEN o_orderstatus || ' years' WHEN kind = 'more' THEN 'or fine' ELSE '' END AS c6, CASE WHEN kind <> 'record' THEN '' WHEN o_orderkey % 41 = 0 THEN 'Any court' ELSE 'Ditto ' || o_orderkey % 2 END AS c7
FROM (SELECT o_orderkey, o_orderstatus, o_custkey % 20 AS document, o_custkey % 300 AS page, CASE WHEN o_orderkey % 53 = 0 THEN 'chapter' WHEN o_orderkey % 7 = 0 THEN 'more' ELSE 'record' END AS kind, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) AS line FROM {orders})"""
_STATE = "CASE WHEN trim({c}) = '' THEN 'unknown' WHEN regexp_matches({c}, '(?i)accor[- ]?ding\\s+as|\\bditto\\b') THEN 'depends' WHEN regexp_matches({c}, '(?i){no}') THEN 'no' WHEN regexp_matches({c}, '(?i){yes}') THEN 'yes' ELSE 'unknown' END"


def _entries_sql() -> str:
    ditto = lambda i: f"regexp_matches(c{i}, '(?i)^\\s*ditto\\b')"
    groups = ", ".join(f"sum(CASE WHEN {ditto(i)} THEN 0 ELSE 1 END) OVER (PARTITION BY document ORDER BY page, part, no) AS g{i}" for i in range(1, 8))
    filled = ", ".join(f"CASE WHEN NOT {ditto(i)} THEN c{i} WHEN coalesce(max(CASE WHEN NOT {ditto(i)} THEN c{i} END) OVER w{i}, '') <> '' THEN max(CASE WHEN NOT {ditto(i)} THEN c{i} END) OVER w{i} ELSE first_value(CASE WHEN {ditto(i)} THEN c{i} END IGNORE NULLS) OVER (w{i} ORDER BY page, part, no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS r{i}" for i in range(1, 8))
    windows = ", ".join(f"w{i} AS (PARTITION BY document, g{i})" for i in range(1, 8))
    cells = ", ".join(f"string_agg(nullif(c{i}, ''), ' ' ORDER BY line) AS c{i}" for i in range(1, 8))
    return f"""WITH l AS ({LINES.format(orders='orders')}), h AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN c1 END IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, line) AS chapter, count(*) FILTER (kind = 'chapter') OVER (PARTITION BY document, page ORDER BY line) AS part FROM l),
n AS (SELECT *, count(*) FILTER (kind = 'record') OVER (PARTITION BY document, page, part ORDER BY line) AS no FROM h WHERE kind <> 'chapter'),
q AS (SELECT document, page, part, no, max(replace(c0, '.', '')) AS section, arg_min(chapter, line) AS chapter, {cells} FROM n WHERE no > 0 GROUP BY 1, 2, 3, 4),
z AS (SELECT * REPLACE ({', '.join(f"coalesce(c{i}, '') AS c{i}" for i in range(1, 8))}) FROM q), g AS (SELECT *, {groups}, row_number() OVER (PARTITION BY document ORDER BY page, part, no) AS ord FROM z),
f AS (SELECT document, ord, page, section, chapter, {filled} FROM g WINDOW {windows})
SELECT 'table ' || document AS document, ord, page, section, chapter, r1 AS offence, r3 AS warrant_or_summons, r6 AS punishment, r7 AS triable_by, {_STATE.format(c='r2', no=r'\b(shall\s+not|may\s+not)\s+arrest\b', yes=r'\bmay\s+arrest\b')} AS cognizable,
{_STATE.format(c='r4', no=r'\bnot\s+bailable', yes=r'\bbailable')} AS bailable, {_STATE.format(c='r5', no=r'\bnot\s+compoundable', yes=r'\bcompoundable')} AS compoundable FROM f"""


@query(_entries_sql())
def q52_table_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at their places, read as tables."""
    laid = spark.sql(LINES, orders=table(spark, sf_dir, "orders"))
    cells = laid.select(F.concat(F.lit("table "), "document").alias("document"), "page", (F.lit(30.0) + 9 * F.col("line")).alias("top"), F.posexplode(F.array(*(F.col(f"c{i}") for i in range(8)))).alias("cell", "t"))
    words = cells.select("document", "page", "top", "cell", F.posexplode(F.array_remove(F.split("t", " "), "")).alias("i", "text"))
    words = words.select("document", "page", (20.0 + 50 * F.col("cell") + 5 * F.col("i")).alias("x0"), (22.0 + 50 * F.col("cell") + 5 * F.col("i")).alias("x1"), "top", "text")
    sheets = cells.select("document", "page").distinct()  # each line has words
    rects = sheets.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("i")).select("document", "page", (50.0 * F.col("i") + 12).alias("x0"), (50.0 * F.col("i") + 13).alias("x1"), F.lit(0.0).alias("top"), F.lit(1e6).alias("bottom"))
    pages = sheets.select("document", "page", F.lit(420.0).alias("width"), F.lit(1e6).alias("height"))
    rules = rects.where("false")
    found = tables.table(words, rects, rules, pages)
    return found.select("document", "ord", "page", "section", "chapter", "offence", "warrant_or_summons", "punishment", "triable_by", "cognizable", "bailable", "compoundable")


_ACT = "CASE doc_id % 4 WHEN 0 THEN 75 WHEN 1 THEN 11 WHEN 2 THEN 24 ELSE 9 END"
_CODE = "CASE {a} WHEN 75 THEN 'CrPC' WHEN 11 THEN 'PenalCode' WHEN 24 THEN 'EvidenceAct' ELSE 'act-9' END"
_NAME = "CASE {a} WHEN 75 THEN 'Code of Criminal Procedure' WHEN 11 THEN 'Penal Code' WHEN 24 THEN 'Evidence Act' ELSE 'act-9' END"
_SAID = "CASE p_size % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'depends' ELSE 'unknown' END"


def _registry_sql() -> str:
    say = lambda c: "CASE {s} WHEN 'yes' THEN '{}' WHEN 'no' THEN '{}' WHEN 'depends' THEN '{}' ELSE '{}' END".format(*chunks.STATED[c], chunks.NOT_STATED, s=_SAID)
    title = f"{_NAME.format(a='act')} || ' section ' || section_number || '. ' || note"
    head = f"CASE WHEN kind = 't' THEN rtrim({STRIP.format(x="'Schedule II — Penal Code section ' || section_number || '. ' || note")}, '.') WHEN kind = 'u' THEN 'Uploaded document — ' || note ELSE rtrim({STRIP.format(x=title)}, '.') END"
    cited = f"CASE WHEN kind = 't' THEN 'Schedule II, Penal Code section ' || section_number WHEN kind = 'u' THEN 'Uploaded section ' || section_number WHEN act = 75 THEN 'section ' || section_number ELSE {_NAME.format(a='act')} || ' section ' || section_number END"
    return rf"""WITH d AS (SELECT doc_id, {_ACT} AS act, lang AS note, {STRIP.format(x='text')} AS text FROM documents),
s AS (SELECT act, doc_id, note, length(text) AS len, sum(length(text) + 2) OVER (PARTITION BY act ORDER BY doc_id) - length(text) - 2 AS st, sum(length(text) + 2) OVER (PARTITION BY act) - 2 AS total FROM d WHERE text <> ''),
l AS (SELECT act, max(total) AS total, max(doc_id) AS last FROM s GROUP BY 1), w AS (SELECT act, total, last, unnest(range(0, total::BIGINT, 850)) AS b FROM l), x AS (SELECT *, least(1000, total - b)::BIGINT AS len FROM w),
j AS (SELECT act, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS whole FROM d WHERE text <> '' GROUP BY 1),
o AS (SELECT x.act, x.b // 850 AS i, substr(whole, x.b + 1, x.len) AS text, coalesce(p.doc_id, last) AS owner, coalesce(p.doc_id, last) <> coalesce(q.doc_id, last) AS crosses FROM x JOIN j USING (act) LEFT JOIN s p ON p.act = x.act AND x.b >= p.st AND x.b < p.st + p.len LEFT JOIN s q ON q.act = x.act AND x.b + x.len - 1 >= q.st AND x.b + x.len - 1 < q.st + q.len),
u AS (SELECT doc_id, lang AS note, b // 1050 AS i, substr(text, b + 1, 1200) AS text FROM (SELECT *, unnest(range(0, length(text), 1050)) AS b FROM documents)),
k AS (SELECT 'n' AS kind, o.act, printf('naive-%s-%05d', {_CODE.format(a='o.act')}, o.i) AS chunk_id, o.text, owner::VARCHAR AS section_number, s.note, crosses FROM o JOIN s ON s.act = o.act AND s.doc_id = o.owner WHERE trim(o.text) <> ''
UNION ALL SELECT 'l', act, 'legal-' || {_CODE.format(a='act')} || '-' || doc_id || '-' || (i - 1), ps[i::BIGINT], doc_id::VARCHAR, note, false FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT act, doc_id, note, {PACKED.format(x='text')} AS ps FROM d WHERE text <> ''))
UNION ALL SELECT 't', NULL, 'sch2-' || p_partkey || '-' || p_size, 'Schedule II of the Code of Criminal Procedure — Penal Code section ' || p_partkey || ': ' || p_name || '.' || chr(10) || {say('cognizable')} || chr(10) || {say('bailable')} || chr(10) || {say('compoundable')} || chr(10) || 'Triable by: ' || p_brand || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Punishment under the Penal Code: ' || p_type ELSE '' END, p_partkey::VARCHAR, p_name, false FROM part
UNION ALL SELECT 'u', NULL, printf('upload-%s-%04d', 'f' || doc_id, i), text, 'p' || (i + 1), note, false FROM u WHERE trim(text) <> '')
SELECT chunk_id, CASE kind WHEN 'n' THEN 'naive_fixed_size' WHEN 'l' THEN 'legal_aware' WHEN 't' THEN 'schedule_rows' ELSE 'uploaded_document' END AS strategy, {cited} AS citation, crosses AS crosses_section_boundary, sha256(text) AS content_hash, sha256({head} || chr(10) || text) AS embedding_hash FROM k"""


@query(_registry_sql())
def q53_strategy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all four strategies in one schema."""
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.expr(_ACT).alias("act_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("number"), "text", F.array("lang").alias("marginal_notes"), F.col("source").alias("part"), F.lit(None).cast("string").alias("chapter"))
    state = F.expr(_SAID)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("section"), F.col("p_size").alias("page"), F.lit(None).cast("string").alias("chapter"), F.col("p_name").alias("offence"), state.alias("cognizable"), state.alias("bailable"), state.alias("compoundable"), F.col("p_brand").alias("triable_by"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("punishment"), F.lit("").alias("warrant_or_summons"))
    uploads = docs.select(F.concat(F.lit("f"), "doc_id").alias("document_id"), F.col("lang").alias("filename"), "text")
    found = chunks.chunked({"naive_fixed_size": sections, "legal_aware": sections, "schedule_rows": rows, "uploaded_document": uploads})
    return found.select("chunk_id", "strategy", "citation", "crosses_section_boundary", "content_hash", F.sha2("embedding_text", 256).alias("embedding_hash"))


def letters() -> index.Model:
    """A model without weights that SQL can follow: how often a text has some letters, and its length."""
    signs = "etaoin "

    def load():
        return lambda texts: np.array([[*(t.count(c) for c in signs), len(t)] for t in texts], dtype=np.float64)

    return index.Model("letters", len(signs) + 1, load)


_COUNTS = "[" + ", ".join(f"length({{x}}) - length(replace({{x}}, '{c}', ''))" for c in "etaoin ") + ", length({x})]::DOUBLE[]"


def _state_sql(where: str, text: str) -> str:
    return f"SELECT doc_id, 'Penal Code section ' || doc_id || '. ' || lang || chr(10) || {text} AS e, sha256({text}) AS h FROM documents WHERE {where}"


@query(f"""WITH old AS ({_state_sql('doc_id % 10 <> 0', 'text')}), new AS ({_state_sql('doc_id % 7 <> 0', "CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END")}),
v AS (SELECT new.doc_id, new.h IS NOT DISTINCT FROM old.h AS reused, {_COUNTS.format(x='new.e')} AS x FROM new LEFT JOIN old USING (doc_id)), n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS size FROM v)
SELECT 'c' || doc_id AS chunk_id, reused, round(x[1] / size, 3) AS first, round(x[8] / size, 3) AS last FROM n""")  # fmt: skip
def q54_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built with a model, then converged: only added and changed chunks are embedded again."""
    docs, model = table(spark, sf_dir, "documents"), letters()
    made = lambda rows, text: chunks.described(rows.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), text.alias("text"), F.col("doc_id").cast("string").alias("number"), "lang", F.lit("PenalCode").alias("document")), "document", "number", "lang", "text")
    old = index.build(made(docs.where("doc_id % 10 <> 0"), F.col("text")), model)
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = index.converge(old, made(docs.where("doc_id % 7 <> 0"), changed), model)
    shown = lambda i: F.round(F.get("vector", F.lit(i)).cast("double"), 3)
    return found.select("chunk_id", "reused", shown(0).alias("first"), shown(7).alias("last"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY low) - 1 AS band, low, coalesce(lead(low) OVER (ORDER BY low), 1e9) AS high FROM (SELECT unnest([0, 1200.5, 3000, 5000, 9999.99, 20000, 40000.25, 60000, 90000]) AS low)),
t AS (SELECT l_orderkey, l_linenumber, 'table ' || l_orderkey % 5 AS document, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem)
SELECT document, band::INT AS band, count(*) AS n FROM t JOIN b ON (x0 + x1) / 2 >= low AND (x0 + x1) / 2 < CASE WHEN band = 7 THEN 90000 ELSE high END WHERE band < 8 GROUP BY 1, 2""")  # fmt: skip
def q13_banded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as words, by the uneven columns that their middles are in."""
    words = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("table "), F.col("l_orderkey") % 5).alias("document"), F.lit(1).alias("page"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))
    edges = F.array(*(F.lit(float(x)) for x in (0, 1200.5, 3000, 5000, 9999.99, 20000, 40000.25, 60000, 90000)))
    sheets = spark.range(5).select(F.concat(F.lit("table "), "id").alias("document"), F.lit(1).alias("page"), edges.alias("edges"))
    return tables.banded(words, sheets).groupBy("document", "band").agg(F.count("*").alias("n"))

