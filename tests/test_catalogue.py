"""Every catalogue query agrees with its SQL, or with a plain computation, on the smallest tables."""

import collections
import hashlib
import re

import pytest

from corpusloom.operators import quotes
from corpusloom.plans import answers, catalogue
from tests.compare import expected, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    found = catalogue.queries()[name](spark, SF)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected(catalogue.oracle_sql()[name], SF)


def _events(spark):
    rows = [r.asDict() for r in catalogue.table(spark, SF, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts AS timestamp)) AS at", "value").collect()]
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        by[r["user_id"]].append(r)
    return by


def test_limiter(spark):
    want, day = {}, 24 * 3600 * 10**6
    for rows in _events(spark).values():
        hits = []
        for r in rows:
            hits = [h for h in hits if h > r["at"] - day]
            if len(hits) >= 3:
                want[r["event_id"]] = (False, 0, (hits[0] + day - r["at"]) / 1e6)
            else:
                hits.append(r["at"])
                want[r["event_id"]] = (True, 3 - len(hits), 0.0)
    assert {r.event_id: tuple(r[1:]) for r in catalogue.queries()["q46_sliding_limiter"](spark, SF).collect()} == want


def test_bucket(spark):
    """Second by second in floating point: a wish waits until the bucket holds it."""
    found = {r.event_id: r for r in catalogue.queries()["q48_token_bucket"](spark, SF).collect()}
    for rows in _events(spark).values():
        level, clock = 7200.0, None
        for r in rows:
            now = r["at"] / 1e6 if clock is None else max(clock, r["at"] / 1e6)
            level = level if clock is None else min(7200.0, level + (now - clock) * 120.0)
            want = min(r["event_id"] % 4000, 7200)
            if level < want:
                now += (want - level) / 120.0
                level = want
            clock, level = now, level - want
            assert abs(found[r["event_id"]].available - level) < 0.01 and abs(found[r["event_id"]].waited - (now - r["at"] / 1e6)) < 0.001


def test_lru(spark):
    found = {r.event_id: r.hit for r in catalogue.queries()["q47_lru_cache"](spark, SF).collect()}
    for rows in _events(spark).values():
        kept = []
        for r in rows:
            v = int((r["value"] or 0.0) // 10)
            assert found[r["event_id"]] == (v in kept)
            kept = [x for x in kept if x != v][-7:] + [v]


def test_packed_sections(spark):
    """Greedy packing of the parts between marks, part by part."""
    want = collections.Counter()
    for r in catalogue.table(spark, SF, "documents").collect():
        pieces = [r.text]
        if len(r.text) > 1400:
            marks = [m.start() for m in re.finditer(r"\(\d+\)|\([a-z]{1,2}\)", r.text)]
            parts = [r.text[a:b] for a, b in zip([0, *marks], [*marks, len(r.text)], strict=True)]
            pieces, now = [], ""
            for part in parts:
                if now and len(now) + len(part) > 1400:
                    pieces.append(now)
                    now = ""
                now += part
            pieces.append(now)
        for i, piece in enumerate(x for x in (p.strip(" ") for p in pieces) if x):
            want[r.doc_id, i, len(piece), hashlib.sha256(piece.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in catalogue.queries()["q17_section_aware_chunks"](spark, SF).collect()) == want


BODY = "Any police-officer may, without an order from a Magistrate, arrest any person who has been concerned in any [cognizable] offence, or against whom a reasonable complaint has been made; and [* * *] shall be bound."


@pytest.mark.parametrize(
    "quote, note, want",
    [
        ("may, without an order from a Magistrate, arrest any person", "", (True, "")),
        ("concerned in any cognizable offence , or against whom", "", (True, "")),
        ("any police‑officer may, without an order", "", (True, "")),
        ("complaint has been made; and shall be bound", "", (True, "")),
        ("54. Any police-officer may, without an order from a Magistrate", "", (True, "label")),
        ("Section 54 — When police may arrest. Any police-officer may, without an order", "When police may arrest.", (True, "label")),
        ("without an order from a Magistrate ... against whom a reasonable complaint", "", (True, "elision")),
        ("54. without an order from a Magistrate … against whom a reasonable complaint", "", (True, "label+elision")),
        ("against whom a reasonable complaint ... without an order from a Magistrate", "", (False, "")),
        ("without an order ... complaint", "", (False, "")),
        ("Any police-officer may, without an order from a Magistrate, arrest any one", "", (True, "trimmed")),
        ("Any police-officer may, without an order, and then goes on to invent a great deal of text", "", (False, "")),
        ("When police may arrest", "When police may arrest", (False, "")),
        ("too short", "", (False, "")),
        ("...", "", (False, "")),
        ("nothing of this is in the section at all", "", (False, "")),
    ],
)
def test_quotations(quote, note, want):
    verified, display, repair = quotes.check(quote, BODY, note)
    assert (verified, repair) == want and bool(display) == verified


@pytest.mark.parametrize(
    "quote, note, want",
    [
        ("[cognizable] offence, or against whom a reasonable complaint has been made]", "", "[cognizable] offence, or against whom a reasonable complaint has been made]"),
        ("54. When police may arrest. Any police-officer may, without an order", "When police may arrest.", "Any police-officer may, without an order"),
        ("When police may arrest - 54. Any police-officer may, without an order", "When police may arrest", "Any police-officer may, without an order"),
        ("any person who has been concerned in any [cognizable] offence but what follows is new", "", "any person who has been concerned in any [cognizable] offence"),
        ("  Any police-officer may,   without an order from a Magistrate  ", "", "Any police-officer may,   without an order from a Magistrate"),
    ],
)
def test_what_is_shown(quote, note, want):
    verified, display, _ = quotes.check(quote, BODY, note)
    assert verified and display == want


def test_reading():
    """One pass gives the canonical form, and where each character is from."""
    for text in (BODY, "", "  ", "[* * *] a . b", "İstanbul [x] , y", "a\u00a0b\u2011c .", "]x[", "a [***] ; b"):
        found = quotes.read(text)
        assert found.form == quotes.plain(text) and len(found.begin) == len(found.end) == len(found.form)
        assert found.until(len(found.form)) == text and found.since(0) == text
    assert quotes.opening("abcdef", "abxabcdxabcdey") == 5 and quotes.opening("zz", "abc") == 0 and quotes.opening("abc", "abc") == 3
    long = "word " * 50_000
    assert quotes.opening(long[:-5] + "x", long) == len(long) - 5


def test_holders(spark):
    """Needles of all lengths against a plain search: empty, one letter, other scripts, longer than any text, more than once."""
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, "beta gamma " * 40), (3, ""), (4, None), (5, "ধারা ৩৭৯ চুরি"), (6, "x"), (7, "the gamma de"), (1, "second part of the first")]
    needles = ["a", "x", "gamma de", "ধারা", "ma delta ep", "beta gamma beta gamma beta gamma beta gamma beta gamma", "nowhere", "z" * 100, "second part", "", "eta gamma d", "৭৯ চু"]
    found = quotes.holders(spark.createDataFrame(list(enumerate(needles)), "key long, n string"), spark.createDataFrame(texts, "doc_id long, c string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted({(k, d) for k, n in enumerate(needles) for d, t in texts if n and n in (t or "")})


def test_long_text(spark):
    """A short needle in a text of a million characters: work is in proportion to it."""
    import time

    text = "".join(f"word{i % 977} " for i in range(120_000))
    sources = spark.createDataFrame([(1, text + "needle x"), (2, text)], "doc_id long, c string")
    asked = spark.createDataFrame([(1, "needle x"), (2, "needle y")], "key long, n string")
    quotes.holders(asked, sources).collect()
    began = time.time()
    assert [tuple(r) for r in quotes.holders(asked, sources).collect()] == [(1, 1)]
    assert time.time() - began < 20


def test_verdicts(spark):
    """All five verdicts against a plain search."""
    sources = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"), (3, "x " * 30 + "alpha beta gamma delta epsilon zeta eta")]
    asked = [
        (1, "mu nu xi omicron pi rho sigma tau", 1, "misattributed", 2),
        (2, "alpha beta ... zeta eta", 1, "overelided", None),
        (3, "zeta eta theta iota kappa ... alpha beta gamma", 1, "recomposed", None),
        (4, "alpha beta gamma delta ... mu nu xi omicron pi rho", 3, "recomposed", None),
        (5, "words which nobody has ever written down", 1, "fabricated", None),
        (6, "lambda mu nu xi omicron ... pi rho sigma tau upsilon", 1, "misattributed", 2),
        (7, "zzzzzzzzzzzzzzzzzzzzzzzzz", 1, "fabricated", None),
        (8, "", 1, "fabricated", None),
        (9, "alpha beta gamma delta ... never written down by anyone", 2, "fabricated", None),
    ]
    found = quotes.explained(spark.createDataFrame([a[:3] for a in asked], "item_id long, quote string, cited long"), spark.createDataFrame(sources, "doc_id long, c string"))
    assert sorted(tuple(r) for r in found.collect()) == [(a[0], a[3], a[4]) for a in asked]
    assert {r.verdict for r in answers.q35_all_verdicts(spark, SF).collect()} <= {"misattributed", "overelided", "recomposed", "fabricated"}


def test_first_holders(spark, monkeypatch):
    """A passage that all texts hold is looked for in the first alone; parts in another order, in rounds of candidates until the last one."""
    one, two, tables = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa lambda", []
    texts = [(i, f"{two} {i} {one}") for i in range(10, 40)] + [(40, f"{one} and {two}"), (41, f"{one} or {two}"), (42, None)]
    asked = [(k, [one]) for k in range(20)] + [(20, [one, two]), (21, [two, one]), (22, [one, "nowhere at all"]), (23, ["mu nu"]), (24, [])]
    keep = quotes.written
    monkeypatch.setattr(quotes, "written", lambda df, name: tables.append((name, keep(df, name))) or tables[-1][1])
    found = quotes.first_holders(spark.createDataFrame(asked, "key long, parts array<string>"), spark.createDataFrame(texts, "doc_id long, c string"))
    assert sorted(tuple(r) for r in found.collect()) == [(k, 10) for k in range(20)] + [(20, 40), (21, 10)]
    assert sum(t.count() for name, t in tables if name == "pairs") <= 22 + 2 * 32


def test_pairs_are_not_broadcast(spark):
    """Pairs of a few KB in files are MB of rows, as they repeat their parts; they stay out of the driver, whatever their files' size."""
    one, two = (" ".join(f"{w}{i}" for i in range(250)) for w in ("word", "term"))
    texts = [(i, f"{two} {i} {one}") for i in range(300)] + [(300, f"{one} {two}")]
    asked = [(k, [one, two]) for k in range(12)] + [(12, [two, one])]
    most = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(most, 2 << 20)
    try:
        found = quotes.first_holders(spark.createDataFrame(asked, "key long, parts array<string>"), spark.createDataFrame(texts, "doc_id long, c string"))
        assert sorted(tuple(r) for r in found.collect()) == [(k, 300) for k in range(12)] + [(12, 0)]
        failed = [(k, f"{one} ... {two}", 0) for k in range(12)]
        verdicts = quotes.explained(spark.createDataFrame(failed, "item_id long, quote string, cited long"), spark.createDataFrame(texts, "doc_id long, c string"))
        assert {(r.verdict, r.source) for r in verdicts.collect()} == {("recomposed", None)}
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("sources_")]
    finally:
        spark.conf.unset(most)
