"""Acts from HTML: rows, footnotes, headings in force, sections with their units, amendments.

Null html is as an empty page. Order is explicit everywhere: row_no within a page, ord of sections.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import small_batches

# Classes of the markup and the column of a row that each fills.
PARTS = {"act-part-group": "part", "act-chapter-group": "chapter", "act-section-head": "heading", "txt-details": "text", "txt-head": "note"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
_ROWS = "row_no long, part string, chapter string, heading string, note string, text string, markers array<int>"
_NOTES = "row_no long, marker int, text string, amending_act_title string, href string"


class Reader(HTMLParser):
    """Collects rows, footnotes, headings and paragraphs of a page in one pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.rows: list[dict] = []
        self.notes: list[dict] = []
        self.heads: dict[str, list[str]] = {}
        self.paragraphs, self.words = 0, []

    def _inside(self, *classes: str) -> bool:
        return any(c in k for _, k in self.open for c in classes)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = set((given.get("class") or "").split())
        if "lineremoves" in classes:
            self.rows.append({"markers": []})
        if tag == "li" and "footnoteList" in classes:
            self.notes.append({"marker": "", "text": [], "title": [], "href": None})
        if self.notes and tag == "a" and self._inside("footnoteList") and "/act-" in (given.get("href") or "") and self.notes[-1]["href"] is None:
            self.notes[-1]["href"] = given["href"]
        self.paragraphs += tag == "p"
        if tag in ("title", "h1", "h3") and tag not in self.heads:
            self.heads[tag] = []
            classes = classes | {f"first-{tag}"}
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        tags = {t for t, _ in self.open}
        if "script" in tags or "style" in tags:
            return
        if self._inside("footnote"):
            if self.rows and data.strip().isdigit() and self._inside("lineremoves"):
                self.rows[-1]["markers"].append(int(data.strip()))
            return
        for head in self.heads:
            if self._inside(f"first-{head}"):
                self.heads[head].append(data)
        if "title" not in tags:
            self.words.append(data)
        if self.notes and self._inside("footnoteList"):
            note = self.notes[-1]
            if "sup" in tags and not note["marker"]:
                note["marker"] = data.strip()
            else:
                note["text"].append(data)
            if "a" in tags:
                note["title"].append(data)
        elif self.rows and self._inside("lineremoves"):
            for name, column in PARTS.items():
                if self._inside(name):
                    self.rows[-1].setdefault(column, []).append(data)


def _read(html: bytes | None) -> Reader:
    reader = Reader()
    reader.feed((html or b"").decode("utf-8", "replace"))
    reader.close()
    return reader


def _pages(pages: DataFrame, key: str, html: str, emit, schema: str) -> DataFrame:
    small_batches(pages.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, page in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                mine = emit(_read(page))
                rows += mine
                keys += [k] * len(mine)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True))], [key, *names])

    return pages.select(F.col(key).cast("long"), F.col(html).cast("binary")).mapInArrow(run, f"{key} long, {schema}")


def rows(pages: DataFrame, key: str = "act_id", html: str = "html") -> DataFrame:
    """A row for each row of a page's markup: its headings (null where it has none), note, text and footnote markers."""
    joined = lambda x: None if x is None else " ".join(x)
    out = _pages(pages, key, html, lambda r: [(i, *(joined(x.get(c)) for c in ("part", "chapter", "heading", "note", "text")), x["markers"]) for i, x in enumerate(r.rows)], _ROWS)
    return out.withColumns({c: T.clean(F.col(c)) for c in ("part", "chapter", "heading", "note", "text")})


def amendments(pages: DataFrame, key: str = "act_id", html: str = "html") -> DataFrame:
    """Footnotes with a number as amendments; the last of a marker counts."""
    notes = _pages(pages, key, html, lambda r: [(i, int(x["marker"]), " ".join(x["text"]), " ".join(x["title"]) or None, x["href"]) for i, x in enumerate(r.notes) if x["marker"].isdigit()], _NOTES)
    last = notes.groupBy(key, "marker").agg(F.max_by(F.struct("text", "amending_act_title", "href"), "row_no").alias("x")).select(key, "marker", "x.*")
    return classified(last.withColumn("text", T.clean(F.col("text")))).select(key, "marker", "operation", "text", F.nullif(T.clean(F.col("amending_act_title")), F.lit("")).alias("amending_act_title"), F.regexp_extract("href", r"/act-(\d+)\.html", 1).try_cast("int").alias("amending_act_id"), "act_number", "effective_from")


def classified(notes: DataFrame) -> DataFrame:
    """Adds operation, act_number and effective_from of amendment notes (text)."""
    return notes.withColumns({"operation": T.operation(F.col("text")), "act_number": T.act_number(F.col("text")), "effective_from": T.effective_from(F.col("text"))})


def _literal(html: Column, references: tuple[str, ...]) -> Column:
    """A page whose ampersands are marked up but for those of the references."""
    return F.regexp_replace(html.cast("string"), rf"&(?!(?:{'|'.join(references)});)", "&amp;")


def page_facts(pages: DataFrame, key: str, html: str, references: tuple[str, ...] | None = None) -> DataFrame:
    """title, h1, number of paragraphs and hash of the visible text of each page. references: the named ones that are decoded, others stay as written; without, all that HTML knows."""
    if references is not None:
        pages = pages.select(key, _literal(F.col(html), references).alias(html))
    head = lambda r, h: "".join(r.heads.get(h, []))
    out = _pages(pages, key, html, lambda r: [(head(r, "title"), head(r, "h1"), head(r, "h3"), r.paragraphs, " ".join(" ".join(r.words).split()))], "title string, h1 string, h3 string, n_paragraphs long, text string")
    return out.withColumns({"act_title": T.title(F.col("h3")), "text_hash": F.sha2("text", 256)})


def sections(found: DataFrame, key: str = "act_id") -> DataFrame:
    """Sections of rows(), in order: a row with a number starts one, "N and M." starts two with the same text, others belong to the one before.

    What follows a pair belongs to its second. Rows before the first section go; so do rows without text, but their headings count.
    """
    window = Window.partitionBy(key).orderBy("row_no")
    part_no = F.count("part").over(window)
    rows_ = found.withColumns({"_p": part_no, "_part": F.last("part", True).over(window)})
    in_part = Window.partitionBy(key, "_p").orderBy("row_no")
    rows_ = rows_.withColumns({"_c": F.count("chapter").over(in_part), "_chapter": F.last("chapter", True).over(in_part)})
    rows_ = rows_.withColumn("_heading", F.last("heading", True).over(Window.partitionBy(key, "_p", "_c").orderBy("row_no")))
    rows_ = rows_.where(F.coalesce(F.col("text"), F.lit("")) != "")
    pair = F.regexp_extract("text", T.SECTION_PAIR, 2) != ""
    first, second = F.when(pair, F.regexp_extract("text", T.SECTION_PAIR, 2)).otherwise(F.regexp_extract("text", T.SECTION_START, 2)), F.regexp_extract("text", T.SECTION_PAIR, 3)
    amended = F.coalesce(F.nullif(F.regexp_extract("text", T.SECTION_PAIR, 1), F.lit("")), F.nullif(F.regexp_extract("text", T.SECTION_START, 1), F.lit(""))).isNotNull()
    rest = F.when(pair, F.regexp_replace("text", T.SECTION_PAIR, "")).otherwise(F.regexp_replace("text", T.SECTION_START, ""))
    rows_ = rows_.withColumns({"_n": first, "_m": F.when(pair, second), "_amended": amended, "_repealed": rest.rlike(T.REPEALED)})
    starts = F.when(F.col("_m").isNotNull(), 2).when(F.col("_n") != "", 1).otherwise(0)
    rows_ = rows_.withColumn("_ord", F.sum(starts).over(window)).where("_ord > 0")
    ords = F.when(F.col("_m").isNotNull(), F.array(F.col("_ord") - 1, F.col("_ord"))).otherwise(F.array("_ord"))
    units = rows_.select("*", F.posexplode(ords).alias("_i", "ord"))
    number = F.when(F.col("_i") == 1, F.col("_m")).when(F.col("_n") != "", F.col("_n"))
    first_of = lambda c: F.min_by(c, "row_no")
    listed = F.array_sort(F.collect_list(F.struct("row_no", F.col("note").alias("marginal_note"), "text", "markers")))
    out = units.groupBy(key, "ord").agg(F.max(number).alias("number"), *(first_of(f"_{c}").alias(c) for c in ("part", "chapter", "heading")), first_of("_amended").alias("whole_section_amended"), first_of("_repealed").alias("is_repealed"), listed.alias("units"))
    return out.withColumns({
        "text": F.array_join("units.text", "\n\n"),
        "marginal_notes": F.filter("units.marginal_note", lambda n: F.coalesce(n, F.lit("")) != ""),
        "footnote_markers": F.array_sort(F.array_distinct(F.flatten("units.markers"))),
    }).withColumn("content_hash", F.sha2("text", 256))


def section(found: DataFrame, number: str, key: str = "act_id") -> DataFrame:
    """The first section of each act with that number."""
    row = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return found.where(F.col("number") == number).withColumn("_i", row).where("_i = 1").drop("_i")


def amendments_of(found: DataFrame, notes: DataFrame, key: str = "act_id") -> DataFrame:
    """The amendments of each section, dated ones first, newest first; markers without a note are left out."""
    marked = found.select(key, "ord", F.posexplode("footnote_markers").alias("i", "marker")).join(notes, [key, "marker"])
    rank = F.row_number().over(Window.partitionBy(key, "ord").orderBy(F.desc_nulls_last("effective_from"), "i"))
    return marked.withColumn("rank", rank.cast("long"))
