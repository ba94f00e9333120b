"""Acts, tables, scalar functions, scores, reports and files on small inputs with the expected values written out."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import acts, chunks, evaluate, gate, index, lookup, reports, tables
from corpusloom.sources import stores

PAGE = """<html><head><title>x</title></head><body><h3>1 The Sample Code, 1898</h3>
<div class="lineremoves"><div class="act-part-group">PART I</div><div class="act-chapter-group">CHAPTER I</div></div>
<div class="lineremoves"><div class="txt-head">Short title.</div><div class="txt-details">1. This is the Code<span class="footnote">7</span> , so named.</div></div>
<div class="lineremoves"><div class="txt-details">It goes on.</div></div>
<div class="lineremoves"><div class="act-chapter-group">CHAPTER II</div><div class="txt-head">Definitions</div><div class="txt-details">4. (1) In this Code (d) [Repealed by another].</div></div>
<div class="lineremoves"><div class="txt-details">[6. Besides the Courts.</div></div>
<div class="lineremoves"><div class="txt-details">23 and 24. [Repealed by Act II.]</div></div>
<div class="lineremoves"><div class="txt-details">after the pair</div></div>
<div class="lineremoves"><div class="act-part-group">PART II</div><div class="txt-details">265-I. Last one.</div></div>
<ul><li class="footnoteList"><sup>2</sup> Substituted by the <a href="/act-1035.html">Code (Amendment) Act</a> (Act No. XXXII of 2009) (with effect from 1st November, 2007).</li>
<li class="footnoteList"><sup>7</sup> The word was omitted by <a href="/act-430.html">another</a>.</li><li class="footnoteList"><sup>x</sup> none</li></ul></body></html>"""


def test_acts(spark):
    pages = spark.createDataFrame([(75, PAGE), (76, None), (77, "")], "act_id long, html string")
    found = acts.sections(acts.rows(pages)).orderBy("ord").collect()
    assert [r.number for r in found] == ["1", "4", "6", "23", "24", "265-I"]
    assert [r.part for r in found] == ["PART I"] * 5 + ["PART II"] and [r.chapter for r in found] == ["CHAPTER I"] + ["CHAPTER II"] * 4 + [None]
    assert [r.is_repealed for r in found] == [False, False, False, True, True, False] and [r.whole_section_amended for r in found] == [False, False, True, False, False, False]
    assert found[0].text == "1. This is the Code, so named.\n\nIt goes on." and found[0].footnote_markers == [7] and found[0].marginal_notes == ["Short title."]
    assert found[3].text != found[4].text and found[4].text.endswith("after the pair")
    notes = acts.amendments(pages)
    rows = {r.marker: r for r in notes.collect()}
    assert set(rows) == {2, 7} and (rows[2].operation, rows[2].amending_act_id, rows[2].act_number, rows[2].effective_from) == ("substituted", 1035, "XXXII of 2009", datetime.date(2007, 11, 1))
    assert (rows[7].operation, rows[7].effective_from, rows[7].amending_act_id) == ("omitted", None, 430)
    assert [(r.ord, r.marker) for r in acts.amendments_of(acts.sections(acts.rows(pages)), notes).collect()] == [(1, 7)]
    assert acts.section(acts.sections(acts.rows(pages)), "4").count() == 1
    facts = {r.act_id: r for r in acts.page_facts(pages, "act_id", "html").collect()}
    assert facts[75].act_title == "The Sample Code, 1898" and facts[76].act_title == "Unknown Act" and len(facts) == 3


def test_scalars(spark):
    cases = [
        (T.clean(F.lit("1872 , section")), "1872, section"), (T.clean(F.lit(". (3) The")), "(3) The"), (T.clean(F.lit("...continued")), "...continued"),
        (T.four_state(F.lit("May not arrest without warrant")), "no"), (T.four_state(F.lit("Accor-ding as")), "depends"), (T.four_state(F.lit("Not bailable"), "bailable"), "no"),
        (T.found_in_order(T.fragments(F.lit("...")), F.lit("x")), False), (T.operation(F.lit("unadded")), "unknown"), (T.operation(F.lit("Substituted and inserted")), "substituted"),
        (T.retry_seconds(F.lit("try again in 1m8.5s")), 83.5), (T.retry_seconds(F.lit("nothing")), 600.0), (T.retry_seconds(F.lit("try again in 9h")), 1800.0), (T.retry_seconds(F.lit("try again in 1s")), 30.0),
        (T.reset_hint(F.lit("try again in 25m")), "about 25 minutes"), (T.section_number(F.lit("s. 265 - i(2)")), "265-I"), (T.section_number(F.lit("none")), None), (T.headword(F.lit("Theft IF committed")), "theft"),
        (T.caller(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("h")), "1.2.3.4"), (T.caller(F.lit(None).cast("string"), F.lit(None).cast("string")), "unknown"), (T.token_estimate(F.lit("")), 1), (T.token_estimate(F.lit("x" * 400)), 100),
        (T.role(F.lit("Act (Amending)"), F.lit("operative")), "operative"), (T.cell(F.lit("4[Court] * * * x")), "Court x"), (T.effective_from(F.lit("(with effect from 31st February, 2001)")), None),
        (T.failure_status(F.lit("TPD reached")), 503), (T.failure_status(F.lit("boom")), 502), (stores.act_paths(F.lit(75))["cache"], "acts/act-print-75.html"),
    ]
    found = spark.range(1).select(*(c.alias(f"x{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(found) == [want for _, want in cases]


def test_table(spark):
    bounds = [50, 100, 150, 200, 250, 300, 350]
    rects = [(1, float(x), x + 1.0, 10.0, 500.0) for x in bounds] + [(2, 50.0, 51.0, 0.0, 90.0)]
    lines = [(1, 10.0, 100.0, 480.0, 480.5), (1, 10.0, 380.0, 300.0, 300.0)]
    words = []
    put = lambda page, top, cells: words.extend((page, 20.0 + 50 * i + 5 * j, 22.0 + 50 * i + 5 * j, float(top), w) for i, c in enumerate(cells) for j, w in enumerate(c.split()))
    put(1, 30, ["Section.", "Offence.", "", "", "", "", "", ""])
    put(1, 60, ["379.", "Theft of prop-", "May arrest", "Warrant", "Not bailable", "Compoundable", "3 years", "Any"])
    put(1, 90, ["", "erty", "without warrant", "", "", "", "", "[Magistrate]"])
    put(1, 120, ["380", "Theft in a house", "Ditto", "Ditto", "Ditto", "Not compoundable", "7 years", "Ditto"])
    put(1, 150, ["", "CHAPTER XVII", "", "", "", "", "", ""])
    put(1, 180, ["381A", "Other", "Shall not arrest", "Summons", "Bailable", "Accor-ding as", "1 year", "Court"])
    put(1, 490, ["", "footnote", "", "", "", "", "", ""])
    words, rects, lines = ([("t", *x) for x in y] for y in (words, rects, lines))
    schema = "document string, page long, x0 double, x1 double, top double"
    w, r, ls = spark.createDataFrame(words, f"{schema}, text string"), spark.createDataFrame(rects, f"{schema}, bottom double"), spark.createDataFrame(lines, f"{schema}, bottom double")
    pages = spark.createDataFrame([("t", 1, 400.0, 520.0), ("t", 2, 400.0, 520.0)], "document string, page long, width double, height double")
    assert {r.page: r.bottom for r in tables.bottoms(ls, pages).collect()} == {1: 480.0, 2: 520.0}
    found = tables.entries(tables.records(tables.lines(w, tables.grid(w, r), tables.bottoms(ls, pages)))).orderBy("ord").collect()
    assert [(x.section, x.chapter) for x in found] == [("379", None), ("380", None), ("381A", "CHAPTER XVII")]
    assert found[0].offence == "Theft of property" and found[0].triable_by == "Any Magistrate" and found[1].cognizable_text == "May arrest without warrant"
    assert [x.cognizable for x in found] == ["yes", "yes", "no"] and [x.bailable for x in found] == ["no", "no", "yes"] and [x.compoundable for x in found] == ["yes", "no", "depends"]
    assert tables.corpus(spark.createDataFrame(found)).count() == 3


def test_lookup(spark):
    rows = [(1, "379", "Theft"), (2, "380", "Theft in a dwelling house, etc."), (3, "302", "Murder"), (4, "379", "Theft"), (5, "1", "Act of such")]
    entries = spark.createDataFrame(rows, "ord long, section string, offence string")
    asked = spark.createDataFrame([(1, "What of theft in a dwelling house?"), (2, "Penal Code section 302 and theft"), (3, "no crime"), (4, None), (5, "thefts")], "qid long, text string")
    found = [tuple(r) for r in lookup.find(asked, entries).orderBy("qid", "rank").select("qid", "ord").collect()]
    assert found == [(1, 2), (1, 1), (1, 4), (2, 3), (2, 1), (2, 4)]
    context = lookup.context(*(spark.createDataFrame(x, "qid long, rank long, identifier string, text string") for x in ([(1, 1, "a", "A")], [(1, 1, "u", "U")], [(1, 1, "a", "again"), (1, 2, "b", "B")])))
    out = {r.qid: r for r in lookup.rendered(context, spark.createDataFrame([(1,), (2,)], "qid long")).collect()}
    assert out[1].identifiers == ["a", "u", "b"] and out[1].prompt == "[a]\nA\n\n---\n\n[u]\nU\n\n---\n\n[b]\nB" and out[2].refused and not out[1].refused


def test_scores(spark):
    answers = spark.createDataFrame([(1, False, None, ["CrPC:1"]), (2, True, None, None), (3, False, "timeout", None)], "qid long, refused boolean, error string, retrieved array<string>")
    cited = [(1, "CrPC", "1", True, True, True, "label", None), (1, "PenalCode", "9", True, True, False, "", "fabricated"), (1, "CrPC", "5", False, False, False, "", None)]
    citations = spark.createDataFrame(cited, "qid long, document string, number string, exists boolean, checked boolean, verified boolean, repair string, verdict string")
    gold = spark.createDataFrame([(1, True, ["CrPC:1"]), (2, False, []), (3, True, ["CrPC:2"])], "qid long, answerable boolean, targets array<string>")
    rows = evaluate.scored(answers, citations, gold)
    x = {r.qid: r for r in rows.collect()}
    assert (x[1].made, x[1].existing, x[1].correct, x[1].valid, x[1].repaired, x[1].fabricated, x[1].retrieval_hit) == (3, 2, 1, 1, 1, 1, True)
    m = rows.agg(*evaluate.metrics()).first()
    assert (m.errors, m.refusal_accuracy, m.excerpt_validity, m.fabrication_rate, m.citation_existence, m.hallucinated_citation_rate) == (1, 1.0, 0.5, 0.5, 0.6667, 0.3333)
    assert rows.where("qid = 3").agg(*evaluate.metrics()).first().refusal_accuracy is None
    assert evaluate.missing_answers(gold, answers.where("qid < 3")).first()[0] == 1
    with pytest.raises(ValueError):
        evaluate.selected(gold, ["x"], {"y"})


def test_gate_and_facts(spark):
    citations = spark.createDataFrame([(1, 0, "379", "Schedule II", "x"), (1, 1, "379", "schedule", ""), (2, 0, "p1", "uploaded", "x")], "qid long, ord int, section string, source string, quote string")
    sources = spark.createDataFrame([("ScheduleII", "379", "Theft of any property is an offence", "Theft")], "document string, number string, body string, note string")
    rows = gate.gate(citations, sources, spark.createDataFrame([], "qid long, identifier string"))
    assert {(r.qid, r.kept) for r in rows.collect()} == {(1, True), (2, False)}
    entries = spark.createDataFrame([(1, "379", "old"), (2, "379", "new")], "ord long, section string, punishment string")
    facts = gate.with_facts(gate.grouped(rows), entries).collect()
    assert len(facts) == 1 and facts[0].offence.punishment == "new" and facts[0].quotes == ["x"]
    replies = spark.createDataFrame([("{}",), ('{"refused": true, "answer": "why"}',), (None,)], "raw string").select(gate.replies(F.col("raw")).alias("r")).collect()
    assert replies[1].r.refused and replies[1].r.answer == "why" and replies[0].r.citations == []


def test_texts_are_stripped_once(spark):
    """Blanks at the ends go as by the pattern alone; the sections' texts are read for spans, windows and facts, no more."""
    texts = [None, "", " ", "a", " a b", "a\r\n", "\u3000a \u00a0", "\u2028x\u2028\u2028", "x\x1f", "\x85\ty\n\n", "\U0001f600 ", "\n\n"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(chunks.stripped(F.col("t")).alias("x"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("y")).collect()
    assert [r.x for r in found] == [r.y for r in found]
    rows = spark.createDataFrame([(75, i, str(i), f" section {i} ", ["n"], "p", "c") for i in range(3)], "act_id long, ord long, number string, text string, marginal_notes array<string>, part string, chapter string")
    made = chunks.fixed_chunks(rows)
    assert made.count() == 1
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_chunks(spark):
    rows = [(1, 1, "a" * 900), (1, 2, "  "), (1, 3, None), (1, 5000, "b" * 900), (2, 1, "c" * 10)]
    found = chunks.windows(spark.createDataFrame(rows, "act long, ord long, text string"), "act", "ord", "text").orderBy("act", "i").collect()
    blank = chunks.windows(spark.createDataFrame([(1, 1, "  abc  "), (1, 2, "\n def")], "act long, ord long, text string"), "act", "ord", "text").collect()
    assert [(r.piece, r.length) for r in blank] == [("abc\n\ndef", 8)]  # blanks at the ends of a section don't count
    assert [(r.start, r.end, r.total) for r in chunks.spans(spark.createDataFrame([(1, 1, "  abc  "), (1, 2, "\n def")], "act long, ord long, text string"), "act", "ord", "text").orderBy("ord").collect()] == [(0, 3, 8), (5, 8, 8)]
    whole = {1: "a" * 900 + "\n\n" + "b" * 900, 2: "c" * 10}
    assert [(r.act, r.i, r.piece) for r in found] == [(a, i, t[i * 850 : i * 850 + 1000]) for a, t in whole.items() for i in range(-(-len(t) // 850))]
    label = chunks.described(spark.createDataFrame([("CrPC", "54", "Arrest.", "body"), ("CrPC", "55", None, "b")], "d string, n string, m string, t string"), "d", "n", "m", "t").orderBy("n").collect()
    assert [r.heading for r in label] == ["Code of Criminal Procedure section 54. Arrest", "Code of Criminal Procedure section 55"] and label[0].identifier == "CrPC:54" and label[0].citation == "section 54"
    with pytest.raises(Exception, match="mixed strategies"):
        index.shape(spark.createDataFrame([("x", "a"), ("x", "b")], "document string, strategy string")).collect()
    acts_ = spark.createDataFrame([(1, "operative"), (2, "amending")], "act_id long, role string")
    assert index.desired(acts_, spark.createDataFrame([(1,), (2,)], "act_id long")).count() == 1
    states = spark.createDataFrame([(i, "unchanged") for i in range(999)] + [(999, "changed")], "id long, status string")
    assert index.report(states).first().summary == "embedded 1 of 1000 chunks (99.9% reused)"


def test_reports(spark):
    rows = [("m", "1", 93, 93, 93, 0, 5, 0.5, None), ("m", "2", 95, 95, 95, 0, 0, 0.25, 0.1)]
    runs = spark.createDataFrame(rows, "model string, stage string, measured long, questions long, dataset_questions long, missing_answers long, errors long, excerpt_validity double, fabrication_rate double")
    assert reports.coverage(runs).first().note == "question counts differ between stages — see the labels below"
    assert reports.coverage(runs.where("stage = 1")).first().note == "same 93 questions throughout, all measured"
    assert {(r.stage, r.metric, r.value) for r in reports.long_form(runs, ["fabrication_rate"]).collect()} == {("1", "fabrication_rate", 0.5), ("2", "fabrication_rate", 0.1)}
    text = reports.markdown(reports.by_model(runs, ["fabrication_rate"]), ["place"])
    assert "| m | 1 | 1 | 93/93 | n/a |" in text and reports.console(runs, ["stage"]).count("\n") == 2
    assert [r.incomplete for r in reports.incomplete(runs).orderBy("stage").collect()] == [True, False]


def test_files(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"id": "a", "slice": "s", "answerable": true}\n\n{"id": "b", "slice": "s"}\n')
    assert stores.gold(spark, str(tmp_path / "gold.jsonl")).count() == 2
    (tmp_path / "twice.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(ValueError, match="duplicate id a"):  # at once, whatever is read
        stores.gold(spark, str(tmp_path / "twice.jsonl"))
    (tmp_path / "answers.jsonl").write_text('{"question_id": "a", "text": "1"}\n{"question_id": "a", "text": "2"}\n')
    assert [r.text for r in stores.answers(spark, str(tmp_path / "answers.jsonl")).collect()] == ["2"] and stores.answers(spark, str(tmp_path / "none.jsonl")).count() == 0
    rows = spark.createDataFrame([("ধারা", 1)], "t string, n long")
    stores.save_rows(rows, str(tmp_path / "rows"))
    assert stores.load_rows(spark, str(tmp_path / "rows"), "t string, n long").collect() == rows.collect()
    assert not stores.index_exists(spark, str(tmp_path / "index"))
    stores.save_index(rows, str(tmp_path / "index"), "m")
    assert stores.index_exists(spark, str(tmp_path / "index")) and stores.load_index(spark, str(tmp_path / "index")).count() == 1
    (tmp_path / "acts").mkdir()
    for name in ("act-print-75.html", "act-print-x.html"):
        (tmp_path / "acts" / name).write_text("<p>x</p>")
    assert [r.act_id for r in stores.acts(spark, str(tmp_path / "acts")).collect()] == [75]
    files = spark.createDataFrame([(b"hello", "a.txt", "text/plain"), (b"%PDF-1", "b.pdf", "application/pdf"), (b"  ", "c.md", None), (b"x", "d.bin", None)], "content binary, filename string, media_type string")
    assert {r.filename: r.error for r in stores.uploads(files).collect()} == {"a.txt": None, "b.pdf": "no PDF reader is installed", "c.md": "empty", "d.bin": "neither text nor PDF"}
    summary = spark.createDataFrame([("m", 1, False)], "model string, stage int, partial boolean")
    stores.save_run(str(tmp_path / "runs/stage-1"), summary, rows, rows.withColumn("answer_text", F.lit("x" * 700)))
    assert stores.complete_runs(spark, str(tmp_path / "runs")).count() == 1
    assert stores.run_folder(2, "ollama") == "stage-2-ollama" and stores.run_folder(2, partial=True) == "scratch/stage-2" and stores.run_folder(1, experiment="x") == "experiments/x/stage-1"
    with pytest.raises(ValueError):
        stores.run_folder(1, experiment="../x")
    cache = spark.createDataFrame([("k", None), ("e", "failed")], "key string, error string")
    assert [r.key for r in stores.uncached(spark.createDataFrame([("k",), ("e",), ("n",)], "key string"), cache).orderBy("key").collect()] == ["e", "n"]


def test_numbers_and_messages(spark):
    from corpusloom.functions import text as T

    rows = spark.createDataFrame([("THE CODE 1898 ( ACT NO. V OF 1898 ) [22nd March]",), ("x" * 900 + "(ACT NO. 1)",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(T.act_number_of_page(F.col("t")).alias("n")).collect()] == ["V OF 1898", None, None, None]
    told = spark.createDataFrame([("tokens per day: try again in 5m0s", True), ("TPD reached", False), ("request timed out", True), ("boom", False), (None, False)], "m string, here boolean").select(T.failure_message(F.col("m"), F.col("here")).alias("t")).collect()
    assert told[0].t == T.SPENT + " It frees up in about 5 minutes." + T.STILL + T.SWITCH and told[1].t == T.SPENT + T.STILL + T.WAIT
    assert told[2].t == T.UNREACHED + "request timed out" + T.LOCAL and told[3].t == T.UNAVAILABLE + "boom" and told[4].t == T.UNAVAILABLE


def test_references_as_written(spark):
    """Only the named references are decoded, once; others, and ones without their semicolon, stay."""
    html = "<title>a &lt;b&gt; &amp;lt; &quot;c&quot; x&amp</title><h1>&nbsp;&amp;&#65;&&lt</h1><p>y"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    found = {r.page_id: (r.title, r.h1, r.n_paragraphs) for r in acts.page_facts(pages, "page_id", "html", ("lt", "gt", "amp")).collect()}
    assert found == {1: ("a <b> &lt; &quot;c&quot; x&amp", "&nbsp;&&#65;&&lt", 1), 2: ("", "", 0)}
    assert acts.page_facts(pages, "page_id", "html").where("page_id = 1").first().title == 'a <b> &lt; "c" x&'


def test_lookup_of_all_phrases(spark):
    """Phrases of stopwords alone are looked for where the caller says so, by the query's SQL too."""
    asked = spark.createDataFrame([(1, "this is on the table"), (2, "is one")], "qid long, text string")
    entries = spark.createDataFrame([(5, "5", "is on"), (6, "6", "a b")], "ord long, section string, offence string")
    assert lookup.find(asked, entries).count() == 0
    assert [(r.qid, r.ord) for r in lookup.find(asked, entries, counts=lambda p: F.length(p) >= 4).collect()] == [(1, 5)]
