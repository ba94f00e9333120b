"""Chunking: fixed windows over joined sections, windows of one text, packed sub-sections, rows of a table; one schema for all of them.

Sections are ordered by a number; positions are summed within runs of RUN numbers first and then over runs, without the texts, so
that a large act isn't one task's. Texts count without the blanks at their ends. Null and blank texts are left out, as are null orders. A section's (act, order) is
unique: rows that repeat it are joined one after another in no stated order. Equal texts under other orders are sections of their own. Empty tables give empty results. Columns of the input
other than the named ones are dropped, whatever their names, except by upload_windows and described, which keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import names, written

SIZE, STEP, GAP = 1000, 850, 2
RUN = 4096
_BLANK = r"(?U)^\s*$"

# Documents, their names, and the sentences of a table's row.
CODE, TABLE, UPLOADED = "CrPC", "ScheduleII", "Uploaded"
CODES = {75: "CrPC", 11: "PenalCode", 24: "EvidenceAct"}
NAMES = {"CrPC": "Code of Criminal Procedure", "PenalCode": "Penal Code", "EvidenceAct": "Evidence Act"}
STATED = {
    "cognizable": ("This is a cognizable offence: the police may arrest without a warrant.", "This is a non-cognizable offence: the police may not arrest without a warrant.", "Whether the police may arrest without a warrant depends on the underlying offence."),
    "bailable": ("This offence is bailable.", "This offence is not bailable.", "Whether this offence is bailable depends on the underlying offence."),
    "compoundable": ("This offence is compoundable.", "This offence is not compoundable.", "Whether this offence is compoundable depends on the underlying offence."),
}
NOT_STATED = "Not stated in the schedule."
LINES = {"triable_by": "Triable by: ", "punishment": "Punishment under the Penal Code: ", "warrant_or_summons": "Warrant or summons in the first instance: "}


def stripped(text: Column) -> Column:
    """A text without the blanks at its ends. Most have none, which the first and the last character tell without a search of the whole text."""
    ends = F.concat(F.substr(text, F.lit(1), F.lit(1)), F.substr(text, F.lit(-1), F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def _sections(sections: DataFrame, act: str, order: str, text: str) -> DataFrame:
    """act, ord, body of the sections that count, under names of our own."""
    rows = sections.select(F.col(act).alias("act"), F.col(order).alias("ord"), stripped(F.col(text)).alias("body"))
    return rows.where("body <> '' AND ord IS NOT NULL")


def _spans(rows: DataFrame) -> DataFrame:
    lengths = rows.select("act", "ord", F.length("body").cast("long").alias("n"), F.floor(F.col("ord") / RUN).alias("run"))
    runs = lengths.groupBy("act", "run").agg(F.sum(F.col("n") + GAP).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("act").orderBy("run")) - F.col("sum")
    runs = runs.select(F.col("act").alias("of"), F.col("run").alias("at"), before.alias("before"), F.sum("sum").over(Window.partitionBy("act")).alias("all"))
    within = F.sum(F.col("n") + GAP).over(Window.partitionBy("act", "run").orderBy("ord")) - F.col("n") - GAP
    placed = lengths.withColumn("within", within).join(runs, F.col("act").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at")))
    start = F.col("before") + F.col("within")
    return placed.select("act", "ord", start.alias("start"), (start + F.col("n")).alias("end"), (F.col("all") - GAP).alias("total"))


def spans(sections: DataFrame, act: str, order: str, text: str) -> DataFrame:
    """act, order, start and end of each section in its act's joined text, pieces GAP characters apart, and that text's length."""
    return _spans(_sections(sections, act, order, text)).withColumnsRenamed({"act": act, "ord": order})


def windows(sections: DataFrame, act: str, order: str, text: str, size: int = SIZE, step: int = STEP, placed: DataFrame | None = None) -> DataFrame:
    """act, i, begin, length and piece of the windows over each act's joined text; blank ones are left out but counted.

    Every section gives its part of the windows that meet it, so that no act's text is put together anywhere. placed: what _spans gives, if it is there already.
    """
    rows = _sections(sections, act, order, text)
    placed = (_spans(rows) if placed is None else placed).withColumnsRenamed({"act": "of", "ord": "at"})
    both = rows.join(placed, F.col("act").eqNullSafe(F.col("of")) & (F.col("ord") == F.col("at")))
    last = F.col("end") == F.col("total")
    body = F.when(last, F.col("body")).otherwise(F.concat("body", F.lit("\n" * GAP)))
    stop = F.when(last, F.col("end")).otherwise(F.col("end") + GAP)
    rows = both.select("act", "ord", "start", "total", body.alias("body"), stop.alias("stop"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - size) / step) + 1)
    rows = rows.select("*", F.explode(F.sequence(first, F.floor((F.col("stop") - 1) / step))).alias("i")).withColumn("begin", F.col("i") * step)
    low, high = F.greatest("begin", "start"), F.least(F.col("begin") + size, "stop")
    part = F.substr("body", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    rows = rows.where(high > low).select("act", "i", "begin", F.struct(F.col("ord").alias("o"), part.alias("t")).alias("x"))
    found = rows.groupBy("act", "i", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "").alias("piece"))  # size characters at most
    return found.where(~F.col("piece").rlike(_BLANK)).select(F.col("act").alias(act), "i", "begin", F.length("piece").cast("long").alias("length"), "piece")


def owners(sections: DataFrame, act: str, order: str, text: str, size: int = SIZE, step: int = STEP, placed: DataFrame | None = None) -> DataFrame:
    """act, i, owner, end_owner, crosses: the sections that hold a window's ends. A position between sections belongs to the act's last one. placed: what _spans gives, if it is there already."""
    placed = _spans(_sections(sections, act, order, text)) if placed is None else placed
    last = placed.groupBy("act").agg(F.max("ord").alias("last_section"), F.max("total").alias("total"))
    listed = last.select("act", "last_section", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))).alias("i", "begin"))
    listed = listed.withColumn("stop", F.least(F.col("begin") + size, "total") - 1)
    # every section offers the windows that begin or end in it; the rest stand in gaps
    hit = lambda shift: (F.ceil((F.col("start") - shift) / step), F.floor((F.col("end") - 1 - shift) / step))
    starts, (low, high) = placed, hit(0)
    starts = starts.where(low <= high).select("act", F.col("ord").alias("owner"), F.explode(F.sequence(low, high)).alias("i"))
    low, high = hit(size - 1)
    ends = placed.where((F.greatest(F.lit(0), low) <= high)).select("act", F.col("ord").alias("end_owner"), F.explode(F.sequence(F.greatest(F.lit(0), low), high)).alias("i"))
    out = listed.join(starts, ["act", "i"], "left").join(ends, ["act", "i"], "left")
    # a window that the end cuts ends in the last section
    end = F.when(F.col("begin") + size > F.col("total"), F.col("last_section")).otherwise(F.coalesce("end_owner", "last_section"))
    return out.select(F.col("act").alias(act), "i", F.coalesce("owner", "last_section").alias("owner"), end.alias("end_owner")).withColumn("crosses", F.col("owner") != F.col("end_owner"))


def upload_windows(docs: DataFrame, text: str, size: int = 1200, step: int = 1050) -> DataFrame:
    """p (from 1) and piece of each window of a text; blank ones are left out but counted."""
    i, at = names(docs, "window_no", "window_at")
    out = docs.where(F.length(text) > 0).select("*", F.posexplode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias(i, at))
    out = out.withColumns({"p": (F.col(i) + 1).cast("long"), "piece": F.substr(text, F.col(at) + 1, F.lit(size))})
    return out.where(F.trim("piece") != "").drop(i, at)


def packed(text: Column, limit: int = 1400) -> Column:
    """Pieces of at most limit characters where sub-section marks allow it; a long part stays whole."""
    parts = F.split(text, r"(?=\(\d+\))|(?=\([a-z]{1,2}\))")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = lambda a, p: F.when((a["open"] != "") & (F.length(a["open"]) + F.length(p) > limit), F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), p.alias("open"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], p).alias("open")))
    pieces = F.aggregate(parts, empty, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    whole = F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces)
    return F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x != "")


def described(chunks: DataFrame, document: str, number: str, note: str, text: str) -> DataFrame:
    """Adds citation, identifier, heading, embedding_text and content_hash of chunks. The hash is of the text alone, so a new note asks for no new vector."""
    of, said = F.col(document), F.coalesce(F.col(note), F.lit(""))
    shown = F.coalesce(*[F.when(of == code, name) for code, name in NAMES.items()], of)
    label = F.when(of == TABLE, F.concat(F.lit("Schedule II — Penal Code section "), number)).otherwise(F.concat(shown, F.lit(" section "), number))
    heading = F.when(of == UPLOADED, F.concat(F.lit("Uploaded document — "), said)).otherwise(F.regexp_replace(stripped(F.concat(label, F.lit(". "), said)), r"\.+$", ""))
    citation = F.when(of == CODE, F.concat(F.lit("section "), number)).when(of == TABLE, F.concat(F.lit("Schedule II, Penal Code section "), number)).otherwise(F.concat(shown, F.lit(" section "), number))
    return chunks.withColumns({
        "citation": citation,
        "identifier": F.concat(document, F.lit(":"), number),
        "heading": heading,
        "embedding_text": F.when(heading == "", F.col(text)).otherwise(F.concat(heading, F.lit("\n"), text)),
        "content_hash": F.sha2(text, 256),
    })


# One schema for the chunks of every strategy.

CHUNK = ("chunk_id", "text", "section_number", "marginal_note", "part", "chapter", "strategy", "crosses_section_boundary", "document")


def document_code(act_id: Column) -> Column:
    return F.coalesce(*[F.when(act_id == i, code) for i, code in CODES.items()], F.concat(F.lit("act-"), act_id.cast("string")))


def _chunk(rows: DataFrame, strategy: str, **columns: Column) -> DataFrame:
    given = {"marginal_note": F.lit(""), "part": F.lit(None), "chapter": F.lit(None), "crosses_section_boundary": F.lit(False), "strategy": F.lit(strategy)} | columns
    kind = lambda c: "boolean" if c == "crosses_section_boundary" else "string"
    return rows.select(*(given[c].cast(kind(c)).alias(c) for c in CHUNK))


def _note(rows: DataFrame) -> Column:
    return F.coalesce(F.get(F.col("marginal_notes"), F.lit(0)), F.lit(""))


def fixed_chunks(sections: DataFrame) -> DataFrame:
    """Fixed windows over each act's sections (act_id, ord, number, text, marginal_notes, part, chapter), under the section that holds their first character."""
    placed = written(_spans(_sections(sections, "act_id", "ord", "text")), "spans")  # without texts; four steps read it
    found = windows(sections, "act_id", "ord", "text", placed=placed).join(owners(sections, "act_id", "ord", "text", placed=placed), ["act_id", "i"])
    facts = sections.select(F.col("act_id").alias("of"), F.col("ord").alias("owner"), "number", _note(sections).alias("note"), "part", "chapter")
    rows = found.join(facts.withColumnRenamed("owner", "at"), (F.col("act_id") == F.col("of")) & (F.col("owner") == F.col("at")))
    document = document_code(F.col("act_id"))
    return _chunk(rows, "naive_fixed_size", chunk_id=F.format_string("naive-%s-%05d", document, F.col("i")), text=F.col("piece"), section_number=F.col("number"), marginal_note=F.col("note"), part=F.col("part"), chapter=F.col("chapter"), crosses_section_boundary=F.col("crosses"), document=document)


def section_chunks(sections: DataFrame) -> DataFrame:
    """A chunk for each section, or for each of its packed sub-sections; none crosses a section."""
    rows = sections.withColumn("text", stripped(F.col("text"))).where("text <> ''").select("act_id", "number", _note(sections).alias("note"), "part", "chapter", F.posexplode(packed(F.col("text"))).alias("i", "piece"))
    document = document_code(F.col("act_id"))
    return _chunk(rows, "legal_aware", chunk_id=F.concat(F.lit("legal-"), document, F.lit("-"), "number", F.lit("-"), "i"), text=F.col("piece"), section_number=F.col("number"), marginal_note=F.col("note"), part=F.col("part"), chapter=F.col("chapter"), document=document)


def row_text(entries: DataFrame) -> tuple[Column, Column]:
    """The offence that a row of the table states, and its sentences."""
    offence = F.coalesce(F.nullif(F.regexp_replace(stripped(F.col("offence")), r"\.+$", ""), F.lit("")), F.lit("(offence not stated)"))
    said = [F.coalesce(*[F.when(F.col(c) == state, text) for state, text in zip(("yes", "no", "depends"), texts, strict=True)], F.lit(NOT_STATED)) for c, texts in STATED.items()]
    more = [F.when(stripped(F.col(c)) != "", F.concat(F.lit(label), stripped(F.col(c)))) for c, label in LINES.items()]
    first = F.concat(F.lit("Schedule II of the Code of Criminal Procedure — Penal Code section "), "section", F.lit(": "), offence, F.lit("."))
    return offence, F.concat_ws("\n", first, *said, *more)


def row_chunks(entries: DataFrame) -> DataFrame:
    """A chunk for each row of a table (section, page, chapter, offence, cognizable, bailable, compoundable, triable_by, punishment, warrant_or_summons)."""
    offence, text = row_text(entries)
    return _chunk(entries, "schedule_rows", chunk_id=F.concat(F.lit("sch2-"), "section", F.lit("-"), F.col("page").cast("string")), text=text, section_number=F.col("section"), marginal_note=offence, chapter=F.col("chapter"), document=F.lit(TABLE))


def upload_chunks(uploads: DataFrame) -> DataFrame:
    """Windows of uploads (document_id, filename, text) as chunks."""
    rows = upload_windows(uploads.select("document_id", "filename", "text"), "text")
    return _chunk(rows, "uploaded_document", chunk_id=F.format_string("upload-%s-%04d", F.col("document_id"), F.col("p") - 1), text=F.col("piece"), section_number=F.concat(F.lit("p"), F.col("p").cast("string")), marginal_note=F.col("filename"), document=F.lit(UPLOADED))


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"naive_fixed_size": fixed_chunks, "legal_aware": section_chunks, "schedule_rows": row_chunks, "uploaded_document": upload_chunks}


def chunked(inputs: dict[str, DataFrame]) -> DataFrame:
    """Chunks of the inputs of each strategy, in one schema with the derived columns; an unknown strategy is an error."""
    if unknown := sorted(set(inputs) - set(STRATEGIES)):
        raise ValueError(f"unknown strategies {unknown}; there are {sorted(STRATEGIES)}")
    found = None
    for name, rows in inputs.items():
        one = STRATEGIES[name](rows)
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no strategy is named")
    return described(found, "document", "section_number", "marginal_note", "text")
