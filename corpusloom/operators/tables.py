"""Rows of tables from positioned words: columns between ruled lines, lines of words, records over lines, dittos, cells.

Relations: words (document, page, x0, x1, top, text), rects and lines (document, page, x0, x1, top, bottom), pages (document, page, width, height). A page without seven
column rules gives nothing. Many tables are read at once: all that goes on over pages (the chapter in force, the number of a record, what a ditto stands for) is found for each page
first, carried from page to page by a row for each page, and given back to the page's rows, so no task has to see a table in one. Lines, records and the rows for pages are
written once, as several steps read them; the rows for pages are then of known size, so that a small number of them is broadcast and words aren't shuffled for them.

Cases: empty relations give empty results. Words that repeat stand twice in their cell. A null document is one table; a null page is first. Words without a position go. Columns other
than the named ones don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import written

# What marks a record, a chapter, and noise.
SECTION = r"^(\d{1,3}[A-Z]{0,3})\s*\.?$"
CHAPTER = r"(?i)CHAPTER\s+[IVXL]+[A-Z]*"
COLUMN_NUMBERS = r"^[1-8](\s+[1-8])+$"
RUNNING_HEAD = r"(?i)Criminal\s+Procedure|1898:\s*Act"
HEADINGS = r"(?i)whether\s+the\s+police|whether\s+a\s+warrant|whether\s+bailable|whether\s+compoun|punishment\s+under\s+the|by\s+what\s+court"
HEADS = ("section.", "section", "offence.", "offence", "not.", "instance.")
RULES, COLUMNS = 7, 8
CELLS = ("offence", "cognizable_text", "warrant_or_summons", "bailable_text", "compoundable_text", "punishment", "triable_by")
DITTO = r"(?i)^\s*ditto\b"

PAGE = ["document", "page"]


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; b's own keys go."""
    other = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return a.join(other, on, how).drop(*(f"other_{k}" for k in keys))


def grid(words: DataFrame, rects: DataFrame) -> DataFrame:
    """document, page, edges: the bounds of a page's columns."""
    upright = rects.where("x1 - x0 < 3 AND bottom - top > 40")
    rules = upright.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.round((F.col("x0") + F.col("x1")) / 2, 1))).alias("centres")).where(F.size("centres") == RULES)
    ends = words.groupBy(*PAGE).agg((F.min("x0") - 3).alias("left"), (F.max("x1") + 3).alias("right"))
    return _same(rules, ends, PAGE).select(*PAGE, F.concat(F.array("left"), "centres", F.array("right")).alias("edges"))


def bottoms(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """document, page, bottom: the highest short level line in the lower part of a page, else its height."""
    short = _same(lines.select(*PAGE, "x0", "x1", "top", "bottom"), pages.select(*PAGE, "width", "height"), PAGE)
    short = short.where((F.abs(F.col("top") - F.col("bottom")) < 2) & (F.col("x1") - F.col("x0") < F.col("width") * 0.6) & (F.col("top") > F.col("height") * 0.4))
    return _same(pages.select(*PAGE, "height"), short.groupBy(*PAGE).agg(F.min("top").alias("rule")), PAGE, "left").select(*PAGE, F.coalesce("rule", F.col("height").cast("double")).alias("bottom"))


def band(edges: Column, at: Column) -> Column:
    """The number of the half-open interval of rising edges that a place is in; null in none."""
    i = F.size(F.filter(edges, lambda e: e <= at)) - 1
    return F.when((i >= 0) & (i < F.size(edges) - 1), i)


def banded(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Words with the band of their page that their middle is in; words in none go. A page's edges are a row."""
    both = _same(words, edges, PAGE)
    return both.withColumn("band", band(F.col("edges"), (F.col("x0") + F.col("x1")) / 2)).where("band IS NOT NULL").drop("edges")


def lines(words: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """document, page, line, cells of a table's lines without noise."""
    sheets = written(_same(edges, ends, PAGE), "sheets")
    above = _same(words.select(*PAGE, "x0", "x1", "top", "text"), sheets, PAGE).where("top < bottom")
    at = (F.col("x0") + F.col("x1")) / 2
    # as band(), for edges of a known number
    i = sum((F.coalesce((F.col("edges")[k] <= at).cast("int"), F.lit(0)) for k in range(COLUMNS + 1)), F.lit(0)) - 1
    found = above.select(*PAGE, F.bround(F.col("top") / 3).cast("long").alias("line"), i.alias("band"), "x0", "text").where(F.col("band").between(0, COLUMNS - 1))
    some = F.sort_array(F.collect_list(F.struct("band", "x0", "text")))  # the words of one line
    cell = lambda k: F.trim(F.array_join(F.filter(some, lambda x: x["band"] == k)["text"], " "))
    # made in the aggregate itself, so that the conditions on lines don't each make them again
    out = found.groupBy(*PAGE, "line").agg(F.array(*(cell(k) for k in range(COLUMNS))).alias("cells"))
    return out.where(~noise(F.col("cells")))


def noise(cells: Column) -> Column:
    some = F.filter(cells, lambda c: c != "")
    joined_ = F.array_join(some, " ")
    marks = [joined_.rlike(m) for m in (COLUMN_NUMBERS, RUNNING_HEAD, HEADINGS)]
    return (joined_ == "") | marks[0] | marks[1] | marks[2] | F.forall(some, lambda c: F.lower(F.trim(c)).isin(*HEADS))


def records(found: DataFrame) -> DataFrame:
    """document, ord, page, section, chapter, cells: a section's number in the first cell starts a record, which ends at the next, a chapter or the page's end.

    ord numbers a document's records from 1.
    """
    section = F.regexp_extract(F.col("cells")[0], SECTION, 1)
    heading = F.regexp_extract(F.array_join("cells", " "), CHAPTER, 0)
    rows = found.select(*PAGE, "line", "cells", section.alias("number"), F.when((section == "") & (heading != ""), heading).alias("heading"))
    # all windows are over a page's lines in one order, so they share a sort
    within = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"here": F.last("heading", True).over(within), "part": F.count("heading").over(within), "starts": F.count(F.when(F.col("number") != "", 1)).over(within)})
    # the start of a record is numbered in its part of the page; what comes before a page's first record, or behind a chapter and before one, goes
    rows = rows.withColumn("no", F.col("starts") - F.coalesce(F.last(F.when(F.col("heading").isNotNull(), F.col("starts")), True).over(within), F.lit(0))).where("no > 0 AND heading IS NULL")
    pieces = F.sort_array(F.collect_list(F.struct("line", "cells")))  # the lines of one record
    made = rows.groupBy(*PAGE, "part", "no").agg(F.max("number").alias("section"), F.first("here").alias("here"), pieces.alias("pieces"))
    column = lambda i: F.aggregate(F.col("pieces")["cells"], F.lit(""), lambda a, c: joined(a, c[i]))
    made = made.select(*PAGE, "part", "no", "section", "here", F.array(*(column(i) for i in range(1, COLUMNS))).alias("cells"))
    made = written(made.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("part", "no"))), "records")
    # a row for each page: its last heading, how many records it has
    headed = found.select(*PAGE, "line", F.when((section == "") & (heading != ""), heading).alias("heading")).groupBy(*PAGE).agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("line"))).alias("last"))
    counted = _same(headed, made.groupBy(*PAGE).agg(F.count("*").alias("n")), PAGE, "left")
    before = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(counted.select(*PAGE, F.last("last", True).over(before).alias("above"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")), "carried")
    out = _same(made, carried, PAGE)
    return out.select("document", (F.col("earlier") + F.col("place")).cast("long").alias("ord"), "page", "section", F.coalesce("here", "above").alias("chapter"), "cells")


def joined(a: Column, b: Column) -> Column:
    """Two pieces of a cell: after a hyphen without it, else after a blank."""
    return F.when(b == "", a).when(a == "", b).when(a.endswith("-"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def undittoed(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (document, page, ord, names) with dittos resolved over a document's pages: a ditto takes the last value before it that isn't one; where that is empty or
    there is none, the text of the first ditto since.
    """
    # all windows are over a page's rows in one order, so they share a sort
    so_far = Window.partitionBy(*PAGE).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    is_ditto = {n: F.col(f"t_{n}") for n in names}
    rows = rows.withColumns({f"t_{n}": F.col(n).rlike(DITTO) for n in names})
    # in a page: the number of values so far
    rows = rows.withColumns({f"g_{n}": F.count(F.when(~is_ditto[n], 1)).over(so_far) for n in names})
    # what a page leaves: its last value, and its first ditto after that
    left = [F.max_by(n, F.when(~is_ditto[n], F.col("ord"))).alias(f"v_{n}") for n in names]
    left += [F.count(F.when(~is_ditto[n], 1)).alias(f"k_{n}") for n in names]
    left += [F.min(F.when(is_ditto[n], F.struct((-F.col(f"g_{n}")).alias("g"), "ord", F.col(n).alias("text")))).alias(f"d_{n}") for n in names]
    pages = rows.groupBy(*PAGE).agg(*left).withColumns({f"d_{n}": F.when(-F.col(f"d_{n}.g") == F.col(f"k_{n}"), F.col(f"d_{n}.text")) for n in names})
    pages = written(pages, "pages")
    order = Window.partitionBy("document").orderBy("page")
    pages = pages.withColumns({f"e_{n}": F.count(F.when(F.col(f"k_{n}") > 0, 1)).over(order) for n in names})
    for n in names:  # pages since the one with the last value
        since = Window.partitionBy("document", f"e_{n}").orderBy("page")
        pages = pages.withColumns({f"b_{n}": F.last(F.when(F.col(f"k_{n}") > 0, F.coalesce(f"v_{n}", F.lit(""))), True).over(order), f"f_{n}": F.first(f"d_{n}", True).over(since)})
    carried = written(pages.select(*PAGE, *(F.lag(f"{x}_{n}").over(order).alias(f"{x}_{n}") for n in names for x in "bf")), "carried")
    # the last value so far, and the first ditto since: the last one that has no other between the value and itself
    opens = {n: is_ditto[n] & ~F.coalesce(F.lag(F.when(is_ditto[n], F.col(f"g_{n}"))).over(Window.partitionBy(*PAGE).orderBy("ord")) == F.col(f"g_{n}"), F.lit(False)) for n in names}
    rows = rows.withColumns({f"o_{n}": opens[n] for n in names})
    rows = rows.withColumns({f"l_{n}": F.last(F.when(~is_ditto[n], F.col(n)), True).over(so_far) for n in names} | {f"z_{n}": F.last(F.when(F.col(f"o_{n}"), F.col(n)), True).over(so_far) for n in names})
    rows = _same(rows, carried, PAGE)
    for n in names:
        leading, first = F.col(f"g_{n}") == 0, F.col(f"z_{n}")
        base = F.when(leading, F.col(f"b_{n}")).otherwise(F.col(f"l_{n}"))
        fallback = F.when(leading, F.coalesce(f"f_{n}", first)).otherwise(first)
        rows = rows.withColumn(f"r_{n}", F.when(~is_ditto[n], F.col(n)).when(F.coalesce(base, F.lit("")) != "", base).otherwise(fallback))
    return rows.select(*(F.col(f"r_{c}").alias(c) if c in names else c for c in rows.columns if not any(c.startswith(f"{x}_") and c[2:] in names for x in "tgolzbfr")))


def entries(found: DataFrame) -> DataFrame:
    """The records with dittos resolved over all pages of their document and cells cleaned and classified."""
    rows = found.select("document", "ord", "page", "section", "chapter", *(F.col("cells")[i].alias(n) for i, n in enumerate(CELLS)))
    rows = undittoed(rows, list(CELLS)).withColumns({n: T.cell(F.col(n)) for n in CELLS})
    return rows.withColumns({"cognizable": T.four_state(F.col("cognizable_text")), "bailable": T.four_state(F.col("bailable_text"), "bailable"), "compoundable": T.four_state(F.col("compoundable_text"), "compoundable")})


def corpus(found: DataFrame) -> DataFrame:
    """document, section, text: one labelled text for each section, of its last entry."""
    parts = [F.when(F.col(c) != "", F.concat(F.lit(label), c)) for label, c in (("Offence: ", "offence"), ("Punishment: ", "punishment"), ("Triable by: ", "triable_by"))]
    return found.groupBy("document", "section").agg(F.max_by(F.concat_ws("\n", *parts), "ord").alias("text"))


def table(words: DataFrame, rects: DataFrame, lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """The entries of all tables, from words to classified cells."""
    return entries(records(written(lines(words, grid(words, rects), bottoms(lines_, pages)), "lines")))
