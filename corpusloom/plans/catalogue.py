"""The catalogue of registered queries with the SQL that each agrees with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks, index, rows

FLAGSHIP = "q35_quote_explain"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def given(name: str, sql: str) -> None:
    """The SQL of a query that is registered elsewhere."""
    _SQL[name] = sql


def queries() -> dict[str, Query]:
    _others()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _others()
    return dict(_SQL)


def _others() -> None:
    """The modules that register the rest; they use what is defined here."""
    from corpusloom.plans import answers, corpora, parsing, scoring  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The canonical form in SQL; the tables hold no marks that RE2 and Java treat apart.
CANON = r"regexp_replace(lower(trim(regexp_replace(translate(regexp_replace({x}, '\[\s*(?:\*\s*)+\]', ' ', 'g'), '‐‑[]', '--  '), '\s+', ' ', 'g'))), ' ([,.;:)\]])', '\1', 'g')"


@query(f"SELECT doc_id, sha256(c) AS canon_hash, length(c) AS canon_len FROM (SELECT doc_id, {CANON.format(x='text')} AS c FROM documents)")
def q01_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("canon_hash"), F.length("c").cast("long").alias("canon_len"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def q02_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(r"SELECT conv_id, turn, sha256('m' || chr(0) || 'i' || chr(0) || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS key FROM conversations WHERE role = 'user'")
def q03_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.cache_key(F.lit("m"), F.lit("i"), F.col("text")).alias("key"))


@query("SELECT lang, sum(greatest(1, length(text) // 4))::BIGINT AS est_tokens_sum FROM documents GROUP BY lang")
def q04_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("est_tokens_sum"))


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section_ord FROM conversations)
SELECT conv_id, section_ord::BIGINT AS section_ord, count(*) AS n_units, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_hash FROM s WHERE section_ord > 0 GROUP BY 1, 2""")
def q05_section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    units = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return found.groupBy("conv_id", "section_ord").agg(F.count("*").alias("n_units"), F.sha2(F.array_join(units, "\n\n"), 256).alias("text_hash"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS p, CASE WHEN event_type = 'signup' THEN event_id END AS c, CASE WHEN event_type = 'view' THEN event_id END AS h FROM events),
a AS (SELECT *, count(p) OVER w AS pn, last_value(p IGNORE NULLS) OVER w AS part FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, count(c) OVER w AS cn, last_value(c IGNORE NULLS) OVER w AS chapter FROM a WINDOW w AS (PARTITION BY user_id, pn ORDER BY ts, event_id))
SELECT event_id, part, chapter, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id, pn, cn ORDER BY ts, event_id) AS heading FROM b""")
def q06_hierarchy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id"))
    return rows.carried(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], of("purchase"), of("signup"), of("view")).select("event_id", "part", "chapter", "heading")


@query("SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\\(\\s*amend(ment|ing)\\s*\\)') THEN 'amending' ELSE 'operative' END AS role FROM (SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ' (Amendment)' ELSE '' END AS text FROM benchmark)")
def q09_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("text", F.when(F.col("item_id") % 3 == 0, " (Amendment)").otherwise(""))
    return table(spark, sf_dir, "benchmark").select("item_id", T.role(title).alias("role"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY eff DESC NULLS LAST, o_orderkey) AS rank, eff FROM
(SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE END AS eff FROM orders)""")
def q11_amendment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    notes = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date")).alias("eff"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("eff"), "o_orderkey")
    return notes.select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("rank"), "eff")


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'error' AS d, CASE WHEN event_type = 'error' THEN 'ditto ' || event_id ELSE props END AS v FROM events),
g AS (SELECT *, sum(CASE WHEN d THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
b AS (SELECT *, max(CASE WHEN NOT d THEN v END) OVER (PARTITION BY user_id, g) AS base, min(CASE WHEN d THEN event_id END) OVER (PARTITION BY user_id, g) AS f FROM g)
SELECT event_id, CASE WHEN NOT d THEN v WHEN coalesce(base, '') <> '' THEN base ELSE 'ditto ' || f END AS resolved FROM b""")
def q12_ditto_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("event_type") == "error"
    value = F.when(d, F.concat(F.lit("ditto "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    return rows.dittos(table(spark, sf_dir, "events"), "user_id", "event_id", value, d).select("event_id", "resolved")


@query("""WITH b AS (SELECT unnest(range(0, (SELECT max(l_extendedprice) FROM lineitem)::BIGINT + 1, 1000)) AS low)
SELECT low::BIGINT AS band, count(*) AS n FROM lineitem JOIN b ON l_extendedprice >= low AND l_extendedprice < low + 1000 GROUP BY 1""")
def q13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # bands are equal in width here, so the range join is a division; operators.tables.banded takes any bounds
    words = table(spark, sf_dir, "lineitem").where("l_extendedprice >= 0")
    return words.groupBy((F.floor(F.col("l_extendedprice") / 1000) * 1000).cast("long").alias("band")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
r AS (SELECT conv_id, i, text AS a FROM c WHERE i = 1 UNION ALL
SELECT c.conv_id, c.i, CASE WHEN r.a = '' THEN c.text WHEN r.a LIKE '%-' THEN substr(r.a, 1, length(r.a) - 1) || c.text ELSE r.a || ' ' || c.text END FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1)
SELECT conv_id, sha256(arg_max(a, i)) AS joined_hash FROM r GROUP BY 1""")
def q14_dehyphenate_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.joined(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.sha2("joined", 256).alias("joined_hash"))


# Sections count without the blanks at their ends.
WINDOWS = r"""WITH d AS (SELECT source, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
s AS (SELECT source, doc_id, length(text) AS len, sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) - length(text) - 2 AS st, sum(length(text) + 2) OVER (PARTITION BY source) - 2 AS total FROM d WHERE text <> ''),
l AS (SELECT source, max(total) AS total, max(doc_id) AS last_section FROM s GROUP BY 1),
w AS (SELECT source, total, last_section, unnest(range(0, total::BIGINT, 850)) AS b FROM l),
x AS (SELECT source, b // 850 AS i, b, least(1000, total - b) AS len, last_section FROM w)
"""


@query(WINDOWS + """, j AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS whole FROM d WHERE text <> '' GROUP BY 1)
SELECT x.source, x.i::BIGINT AS i, x.b::BIGINT AS start, x.len::BIGINT AS len, sha256(substr(whole, x.b + 1, x.len::BIGINT)) AS sha FROM x JOIN j USING (source) WHERE trim(substr(whole, x.b + 1, x.len::BIGINT)) <> ''""")
def q15_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.windows(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return found.select("source", "i", F.col("begin").alias("start"), F.col("length").alias("len"), F.sha2("piece", 256).alias("sha"))


@query(WINDOWS + """SELECT x.source, x.i::BIGINT AS i, coalesce(p.doc_id, last_section) AS owner, coalesce(q.doc_id, last_section) AS end_owner, coalesce(p.doc_id, last_section) <> coalesce(q.doc_id, last_section) AS crosses FROM x
LEFT JOIN s p ON p.source = x.source AND x.b >= p.st AND x.b < p.st + p.len
LEFT JOIN s q ON q.source = x.source AND x.b + x.len - 1 >= q.st AND x.b + x.len - 1 < q.st + q.len""")
def q16_window_owner_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.owners(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query()
def q17_section_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.packed(F.col("text"))).alias("piece", "t"))
    return docs.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("t").cast("long").alias("len"), F.sha2("t", 256).alias("sha"))


@query("SELECT p_partkey AS id, sha256('Part ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || CASE WHEN p_size > 25 THEN 'This is a large part.' ELSE 'This is a small part.' END) AS text_hash FROM part")
def q18_render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") > 25, "This is a large part.").otherwise("This is a small part.")
    line = F.concat_ws("\n", F.concat(F.lit("Part "), "p_name"), F.concat(F.lit("Brand: "), "p_brand"), size)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2(line, 256).alias("text_hash"))


@query("SELECT doc_id, (b // 1050 + 1)::BIGINT AS p, length(substr(text, b + 1, 1200)) AS len FROM (SELECT doc_id, text, unnest(range(0, length(text), 1050)) AS b FROM documents) WHERE trim(substr(text, b + 1, 1200)) <> ''")
def q19_upload_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.upload_windows(table(spark, sf_dir, "documents"), "text").select("doc_id", "p", F.length("piece").cast("long").alias("len"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def q20_l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(index.norm("embedding"), 4).alias("norm"))


TOP = """WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id, list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM embeddings, q),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return index.top_k(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), vectors, k)


@query(TOP + "SELECT qid, rank, vec_id, round(score, 4) AS score4 FROM t WHERE rank <= 8")
def q21_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 8).select("qid", "rank", "vec_id", F.round("score", 4).alias("score4"))


@query("SELECT source, substr(sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(text) || chr(0), '' ORDER BY doc_id::VARCHAR, sha256(text))), 1, 12) AS fp12 FROM documents GROUP BY source")
def q22_index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fingerprint(table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256)), "source", "doc_id", "sha")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    old = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.col("sha").alias("hash"))
    new = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha")).alias("hash"))
    return index.diff(old, new)


STATES = """WITH old AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0),
d AS (SELECT CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' WHEN old.hash <> new.hash THEN 'changed' ELSE 'unchanged' END AS status FROM old FULL OUTER JOIN new ON old.id = new.id)
"""


@query(STATES + "SELECT status, count(*) AS n FROM d WHERE status IS NOT NULL GROUP BY 1")
def q23_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(STATES + """, n AS (SELECT count(*) FILTER (status = 'added') AS a, count(*) FILTER (status = 'removed') AS r, count(*) FILTER (status IN ('removed', 'changed', 'unchanged')) AS b FROM d)
SELECT a AS added, r AS removed, round((a + r) / b, 4) AS churn, (a + r) / b > 0.25 AS refuse FROM n""")
def q25_churn_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.churn(_states(spark, sf_dir))


@query(r"SELECT p_partkey AS id, trim(regexp_replace(lower(regexp_split_to_array(p_name, '[.,;]| if | when | where ')[1]), '\s+', ' ', 'g')) AS head FROM part")
def q26_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.headword(F.col("p_name")).alias("head"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q30_json_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


QUOTES = f"""WITH b AS (SELECT doc_id, {CANON.format(x='text')} AS c FROM documents), q AS (SELECT item_id, {CANON.format(x='text')} AS n FROM benchmark),
f AS (SELECT item_id, n, min(doc_id) AS first_source FROM q LEFT JOIN b ON length(n) >= 20 AND contains(c, n) GROUP BY 1, 2)
"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, n, first_source of each quotation: the first document that holds it."""
    from corpusloom.operators import quotes

    docs = table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("c"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", T.canonical(F.col("text")).alias("n"))
    return quotes.located(asked, docs)


@query(QUOTES + "SELECT item_id, first_source IS NOT NULL AS verified FROM f")
def q33_quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("item_id", F.col("first_source").isNotNull().alias("verified"))


@query(QUOTES + "SELECT item_id, CASE WHEN first_source IS NULL THEN 'fabricated' ELSE 'verified' END AS verdict, first_source FROM f")
def q35_quote_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("item_id", F.when(F.col("first_source").isNull(), "fabricated").otherwise("verified").alias("verdict"), "first_source")


SCORES = "WITH a AS (SELECT doc_id, lang, n_chars > 50 AS measured, n_chars > 2000 AS refused, quality = 1 AS answerable, toxic = 0 AS correct FROM labels JOIN documents USING (doc_id))\n"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    both = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.select("doc_id", "lang", (F.col("n_chars") > 50).alias("measured"), (F.col("n_chars") > 2000).alias("refused"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("correct"))


@query(SCORES + "SELECT doc_id, measured, measured AND refused <> answerable AS decided, correct FROM a")
def q36_score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "measured", (F.col("measured") & (F.col("refused") != F.col("answerable"))).alias("decided"), "correct")


def _metrics() -> list:
    measured, decided = F.col("measured"), F.col("measured") & (F.col("refused") != F.col("answerable"))
    return [
        F.count("*").alias("n"),
        F.count_if(~measured).alias("errors"),
        T.ratio(F.count_if(decided), F.count_if(measured)).alias("refusal_accuracy"),
        T.ratio(F.count_if(measured & F.col("answerable") & F.col("correct")), F.count_if(measured & F.col("answerable"))).alias("hit_rate"),
    ]


METRICS = """count(*) AS n, count(*) FILTER (NOT measured) AS errors, round(count(*) FILTER (measured AND refused <> answerable)::DOUBLE / nullif(count(*) FILTER (measured), 0), 4) AS refusal_accuracy,
round(count(*) FILTER (measured AND answerable AND correct)::DOUBLE / nullif(count(*) FILTER (measured AND answerable), 0), 4) AS hit_rate"""


@query(SCORES + f"SELECT {METRICS} FROM a")
def q38_aggregate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).agg(*_metrics())


@query(SCORES + f"SELECT lang, grouping(lang)::BIGINT AS total, {METRICS} FROM a GROUP BY GROUPING SETS ((lang), ())")
def q39_aggregate_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).rollup("lang").agg(F.grouping("lang").cast("long").alias("total"), *_metrics())


@query("""SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NULL THEN 'section missing' WHEN trim(d.text) = '' THEN 'empty text' WHEN quality = 0 AND toxic = 1 THEN 'unanswerable with labels' END AS problem
FROM labels l LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR trim(d.text) = '' OR (quality = 0 AND toxic = 1)""")
def q40_gold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.trim("text") == "").alias("empty"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    problem = F.when(F.col("empty").isNull(), "section missing").when(F.col("empty"), "empty text").when((F.col("quality") == 0) & (F.col("toxic") == 1), "unanswerable with labels")
    return both.select(F.col("doc_id").alias("id"), problem.alias("problem")).where("problem is not null")


RECALL = TOP + """, l AS (SELECT t.qid, t.rank, v.label, g.label AS gold FROM t JOIN embeddings v ON v.vec_id = t.vec_id JOIN embeddings g ON g.vec_id = t.qid WHERE t.vec_id <> t.qid AND t.rank <= 21),
m AS (SELECT qid, gold, label, min(rank) AS r FROM l GROUP BY ALL), k AS (SELECT qid, gold, label, row_number() OVER (PARTITION BY qid ORDER BY r) AS pos FROM m),
h AS (SELECT qid, min(CASE WHEN label = gold THEN pos END) AS pos FROM k GROUP BY 1)
"""


@query(RECALL + "SELECT c::BIGINT AS cutoff, round(count(*) FILTER (pos <= c)::DOUBLE / count(*), 4) AS recall FROM h, (SELECT unnest([1, 3, 5, 8, 10, 20]) AS c) GROUP BY 1")
def q41_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _top(spark, sf_dir, 21).where("vec_id <> qid").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("gold")), "qid")
    first = hits.groupBy("qid", "gold", "label").agg(F.min("rank").alias("r"))  # distinct labels in order of rank
    ranked = first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("r")))
    found = ranked.groupBy("qid").agg(F.min(F.when(F.col("label") == F.col("gold"), F.col("pos"))).alias("pos"))
    cuts = (1, 3, 5, 8, 10, 20)
    wide = found.agg(*[T.ratio(F.count_if(F.col("pos") <= c), F.count("*")).alias(str(c)) for c in cuts])
    return wide.unpivot([], [str(c) for c in cuts], "cutoff", "recall").select(F.col("cutoff").cast("long").alias("cutoff"), "recall")


@query()
def q46_sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import state

    return state.limited(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), limit=3, window=24 * 3600)


@query()
def q48_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import state

    return state.bucket(table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 4000).alias("want")), per_minute=8000)
