"""Re-scoring makes anew what something has changed for; parsed pages are kept; checks run whatever is read."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import acts, chunks, evaluate
from corpusloom.sources import scratch, stores

BODY = {"1": "alpha beta gamma delta epsilon zeta eta theta", "2": "iota kappa lambda mu nu xi omicron pi rho", "3": "sigma tau upsilon phi chi psi omega and more"}


def given(spark, bodies=BODY, more=()):
    sources = spark.createDataFrame([(int(n), "CrPC", n, b, "") for n, b in bodies.items()], "ord long, document string, number string, body string, note string")
    answers = spark.createDataFrame([(1, False, None, ["CrPC:1"]), (2, False, None, []), (3, True, None, None), (4, False, "timeout", None), *more], "qid long, refused boolean, error string, retrieved array<string>")
    cited = [(1, 0, "s. 1", "", "alpha beta gamma delta"), (1, 1, "s. 9", "", "x"), (2, 0, "s. 2", "", "sigma tau upsilon phi chi"), (2, 1, "2", "", "never written by anyone at all"), (4, 0, "s. 1", "", "alpha beta gamma delta")]
    citations = spark.createDataFrame(cited, "qid long, ord int, section string, source string, quote string")
    gold = spark.createDataFrame([(1, True, ["CrPC:1"]), (2, True, ["CrPC:3"]), (3, False, []), (4, True, ["CrPC:1"]), (5, True, ["CrPC:2"])], "qid long, answerable boolean, targets array<string>")
    return answers, citations, gold, sources


def rows(df):
    return {r.qid: tuple(r[c] for c in (*evaluate.COUNTS, "retrieval_hit", "measured", "decided_correctly")) for r in df.collect()}


def test_scores_from_citations(spark):
    answers, citations, gold, sources = given(spark)
    found = {r.qid: r for r in evaluate.scored(answers, evaluate.verified(citations, sources), gold).collect()}
    one, two = found[1], found[2]
    assert (one.made, one.existing, one.correct, one.checked, one.valid, one.retrieval_hit) == (2, 1, 1, 1, 1, True)
    assert (two.made, two.existing, two.correct, two.checked, two.valid, two.misattributed, two.fabricated) == (2, 2, 0, 2, 0, 1, 1)
    assert (found[4].made, found[4].checked, found[4].measured) == (0, 0, False) and set(found) == {1, 2, 3, 4}
    summary = evaluate.identity(spark.createDataFrame([(0.5, 0.25, 0.25, 0.0, 0.0)], "excerpt_validity double, misattribution_rate double, fabrication_rate double, overelision_rate double, recomposition_rate double"))
    assert summary.count() == 1
    with pytest.raises(ValueError, match="another number than 1"):
        evaluate.identity(summary.withColumn("fabrication_rate", F.lit(0.5)))


def test_rescored(spark):
    answers, citations, gold, sources = given(spark)
    first, n = evaluate.rescored(None, answers, citations, gold, sources)
    assert n == {"scored": 4, "kept": 0, "missing": 1}
    again, n = evaluate.rescored(first, answers, citations, gold, sources)
    assert n == {"scored": 0, "kept": 4, "missing": 1} and rows(again) == rows(first)
    # the body that answer 1 cites changes: it, and answer 2, whose verdicts follow from all sources
    changed = given(spark, BODY | {"1": "other words than the ones there were before"})[3]
    third, n = evaluate.rescored(again, answers, citations, gold, changed)
    assert n["scored"] == 3 and rows(third) == rows(evaluate.rescored(None, answers, citations, gold, changed)[0]) and rows(third)[1] != rows(first)[1]
    # a source that nobody cites and no verdict needs is gone: answer 2 alone, which is fabricated now
    fewer = given(spark, {k: v for k, v in BODY.items() if k != "3"})[3]
    fourth, n = evaluate.rescored(again, answers, citations, gold, fewer)
    assert n["scored"] == 1 and rows(fourth)[2] != rows(first)[2] and rows(fourth) == rows(evaluate.rescored(None, answers, citations, gold, fewer)[0])
    # gold of one question; an answer that is new
    other = gold.withColumn("answerable", F.when(F.col("qid") == 3, True).otherwise(F.col("answerable")))
    assert evaluate.rescored(again, answers, citations, other, sources)[1]["scored"] == 1
    assert evaluate.rescored(again, *given(spark, more=[(5, False, None, None)]))[1] == {"scored": 1, "kept": 4, "missing": 0}
    previous = spark.createDataFrame([("m", 2, 0.5)], "model string, stage int, excerpt_validity double")
    told = evaluate.resummarised(again, previous, gold).first()
    assert (told.model, told.stage, told.rescored_with, told.dataset_questions, told.missing_answers, told.questions) == ("m", 2, evaluate.SCORER, 5, 1, 4)


def test_parsed_pages_are_kept(spark, tmp_path):
    folder, store = tmp_path / "acts", str(tmp_path / "store")
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        stores.parsed(spark, str(folder), store, "1", None)
    page = lambda n, text: (folder / f"act-print-{n}.html").write_text(f'<h3>Act</h3><div class="lineremoves"><div class="txt-details">1. {text}</div></div>')
    for n in (1, 2, 3):
        page(n, f"words {n}")
    parse = lambda pages: acts.sections(acts.rows(pages)).select("act_id", "number", "text")
    first, n = stores.parsed(spark, str(folder), store, "1", parse)
    assert n == {"parsed": 3, "kept": 0} and {r.text for r in first.collect()} == {f"1. words {i}" for i in (1, 2, 3)}
    assert stores.parsed(spark, str(folder), store, "1", None)[1] == {"parsed": 0, "kept": 3}  # nothing is parsed: no parser is needed
    page(2, "other words")
    second, n = stores.parsed(spark, str(folder), store, "1", parse)
    assert n == {"parsed": 1, "kept": 2} and {r.text for r in second.collect()} == {"1. words 1", "1. other words", "1. words 3"}
    assert stores.parsed(spark, str(folder), store, "2", parse)[1] == {"parsed": 3, "kept": 0}
    page(4, "")
    assert stores.parsed(spark, str(folder), store, "1", parse)[1] == {"parsed": 1, "kept": 3}


def test_crossing_hits(spark):
    """A window that two sections share delivers a fragile hit."""
    docs = spark.createDataFrame([("a", 1, "x" * 600), ("a", 2, "y" * 600), ("a", 3, "z" * 3000)], "act string, ord long, text string")
    placed = chunks.spans(docs, "act", "ord", "text").select("act", F.col("ord").cast("string").alias("number"), "start", "end")
    windows = chunks.windows(docs, "act", "ord", "text")
    gold = spark.createDataFrame([(1, "s", "1"), (2, "s", "3"), (3, "t", "2"), (4, "t", "9")], "qid long, slice string, number string")
    hits = spark.createDataFrame([(1, 1, "a", 0), (2, 1, "a", 3), (2, 11, "a", 1), (3, 1, "a", 0), (4, 1, "a", 0)], "qid long, rank int, act string, i long")
    for bucket in (4096, 100, 7):
        found = {r.slice: (r.questions, r.hits, r.crossing) for r in evaluate.crossing(hits, gold, placed, windows, bucket=bucket).collect()}
        assert found == {"s": (2, 2, 1), "t": (2, 0, 0)}


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown strategies"):
        chunks.chunked({"by_guess": spark.range(1)})
    sections = spark.createDataFrame([(75, 1, "54", "  Arrest of persons. ", ["When police may arrest."], None, "V"), (75, 2, "55", "   ", [], None, None), (3, 1, "1", "(1) " + "a" * 900 + " (2) " + "b" * 900, [], "I", None)], "act_id int, ord long, number string, text string, marginal_notes array<string>, part string, chapter string")
    found = {r.chunk_id: r for r in chunks.chunked({"legal_aware": sections, "naive_fixed_size": sections}).collect()}
    assert found["legal-CrPC-54-0"].heading == "Code of Criminal Procedure section 54. When police may arrest" and found["legal-CrPC-54-0"].text == "Arrest of persons."
    assert {c for c in found if c.startswith("legal")} == {"legal-CrPC-54-0", "legal-act-3-1-0", "legal-act-3-1-1"} and found["legal-act-3-1-1"].part == "I"
    assert not any(r.crosses_section_boundary for c, r in found.items() if c.startswith("legal")) and found["naive-act-3-00000"].section_number == "1"
    entry = spark.createDataFrame([("379", 3, "XVII", "Theft. ", "yes", "no", "depends", "Any Magistrate", " ", "Warrant")], "section string, page int, chapter string, offence string, cognizable string, bailable string, compoundable string, triable_by string, punishment string, warrant_or_summons string")
    row = chunks.chunked({"schedule_rows": entry}).first()
    assert row.chunk_id == "sch2-379-3" and row.marginal_note == "Theft" and row.citation == "Schedule II, Penal Code section 379"
    assert row.text.split("\n") == ["Schedule II of the Code of Criminal Procedure — Penal Code section 379: Theft.", chunks.STATED["cognizable"][0], chunks.STATED["bailable"][1], chunks.STATED["compoundable"][2], "Triable by: Any Magistrate", "Warrant or summons in the first instance: Warrant"]


def test_asserted(spark):
    rows_ = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert scratch.asserted(rows_, F.col("n") > 2, "no") is rows_
    with pytest.raises(ValueError, match="bad b of 2"):
        scratch.asserted(rows_, F.col("n") > 1, "bad", F.col("s"), "of", F.col("n"))
