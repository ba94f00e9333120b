"""Many positioned tables at once against one table by hand and a plain fold."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import tables

LINE = "document string, page long, line long, cells array<string>"


def plain(rows):
    """Records and dittos of one table, line by line."""
    out, chapter = [], None
    for page in sorted({r[1] for r in rows}):
        now = None
        for _, _, _, cells in sorted((r for r in rows if r[1] == page), key=lambda r: r[2]):
            number = re.match(r"^(\d{1,3}[A-Z]{0,3})\s*\.?$", cells[0])
            heading = re.search(r"CHAPTER\s+[IVXL]+[A-Z]*", " ".join(cells))
            if not number and heading:
                now, chapter = None, heading[0]
            elif number:
                now = [page, number[1], chapter, list(cells[1:])]
                out.append(now)
            elif now:
                for i, c in enumerate(cells[1:]):
                    old = now[3][i]
                    now[3][i] = old if not c else c if not old else old[:-1] + c if old.endswith("-") else f"{old} {c}"
    for i in range(7):
        before = ""
        for r in out:
            if re.match(r"(?i)^\s*ditto\b", r[3][i]):
                r[3][i] = before or r[3][i]
            before = r[3][i]
    return [(n, *r[:3], *r[3]) for n, r in enumerate(out, 1)]


def made(document, seed):
    random.seed(seed)
    rows = []
    for page in range(random.randrange(1, 7)):
        for line in range(random.randrange(0, 12)):
            kind = random.random()
            if kind < 0.1:
                cells = ["", "CHAPTER " + random.choice(["X", "XV", "LI"]), *[""] * 6]
            elif kind < 0.3:
                cells = ["", *(random.choice(["", "more", "half-"]) for _ in range(7))]
            else:
                cells = [f"{random.randrange(1, 999)}.", *(random.choice(["Ditto", "ditto as above", "", "May arrest", "half-", "Bailable"]) for _ in range(7))]
            rows.append((document, page, line * 3, cells))
    return rows


def test_many_tables(spark):
    parts = {f"t{i}": made(f"t{i}", i) for i in range(12)}
    rows = spark.createDataFrame([r for p in parts.values() for r in p], LINE).repartition(5)
    found = tables.undittoed(tables.records(rows).select("document", "ord", "page", "section", "chapter", *(F.col("cells")[i].alias(c) for i, c in enumerate(tables.CELLS))), list(tables.CELLS))
    got = {}
    for r in found.select("document", "ord", "page", "section", "chapter", *tables.CELLS).collect():
        got.setdefault(r.document, []).append(tuple(r[1:]))
    for name, part in parts.items():
        assert sorted(got.get(name, [])) == plain(part), name


def test_no_window_is_over_a_whole_table(spark):
    """All windows are over a page, or over a row for each page."""
    rows = spark.createDataFrame(made("t", 1), LINE)
    plan = tables.entries(tables.records(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("[document" in line or "document#" in line for line in plan.split("\n") if line.strip(" +-:").startswith("Window"))
    assert tables.entries(tables.records(spark.createDataFrame([], LINE))).collect() == []
    assert isinstance(rows.schema, StructType)


def test_no_table(spark):
    words = spark.createDataFrame([], "document string, page long, x0 double, x1 double, top double, text string")
    rects = spark.createDataFrame([], "document string, page long, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([("t", 1, 1.0, 1.0)], "document string, page long, width double, height double")
    assert tables.table(words, rects, rects, pages).collect() == []


def test_words_are_read_for_the_lines_once(spark):
    """What is left to run after table() reads the records and rows for pages, not the words again; cells are the words in order."""
    words = spark.createDataFrame([("t", 1, 10.0, 12.0, 30.0, "7."), ("t", 1, 66.0, 70.0, 30.0, "b"), ("t", 1, 60.0, 64.0, 30.0, "a"), ("t", 1, 110.0, 114.0, 30.0, "Ditto"), ("t", 1, 360.0, 364.0, 33.0, "court")], "document string, page long, x0 double, x1 double, top double, text string")
    rects = spark.createDataFrame([("t", 1, 50.0 * i, 50.0 * i + 1, 0.0, 100.0) for i in range(1, 8)], "document string, page long, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([("t", 1, 400.0, 500.0)], "document string, page long, width double, height double")
    found = tables.table(words, rects, rects.where("false"), pages)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3
    assert [(r.ord, r.section, r.offence, r.cognizable_text, r.triable_by) for r in found.collect()] == [(1, "7", "a b", "Ditto", "court")]
