"""Scalar text functions as Column expressions. Regular expressions are Unicode-aware where they meet white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and numbers that results depend on.
OMITTED = r"\[\s*(?:\*\s*)+\]"
ELLIPSIS = r"\s*(?:\.\s*\.\s*\.|…)\s*"
EDGE = " ,;:."
SECTION_START = r"^\s*(\[\s*)?(\d+(?:-?[A-Z]{1,3})?)\s*\."
SECTION_PAIR = r"^\s*(\[\s*)?(\d+(?:-?[A-Z]{1,3})?)\s+and\s+(\d+(?:-?[A-Z]{1,3})?)\s*\."
REPEALED = r"(?i)^\s*\[?\s*(?:Repealed|Omitted)\b"
OPERATIONS = ("renumbered", "substituted", "inserted", "omitted", "repealed", "added")
MONTHS = "january february march april may june july august september october november december"
ACT_NUMBER = r"(?i)\((?:Act|Ordinance|President's Order)\s+No\.\s*([^)]+)\)"
STOPWORDS = (
    "a an the of or and to in for by with any other such person persons property offence offences act if when where which whoever thereby "
    "being made not under upon his her their its on at from into as is are be may shall"
)
HEADER = 800
HEAD_NUMBER = r"(?i)\(\s*ACT\s+NO\.\s*([^)]+?)\s*\)"
DAILY = ("tokens per day", "tpd", "requests per day", "rpd")
UNREACHABLE = ("connection", "timed out", "timeout", "unreachable")


def canonical(text: Column) -> Column:
    """Form in which quotations are compared: omission marks and brackets are blanks, hyphens are one, case and spacing don't count."""
    out = F.regexp_replace(text, OMITTED, " ")
    out = F.translate(out, "‐‑[]", "--  ")
    out = F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))
    return F.regexp_replace(out, r" ([,.;:)\]])", "$1")


def clean(text: Column) -> Column:
    """Text of markup: single blanks, none before closing punctuation, no stop before an opening bracket at the start."""
    out = F.trim(F.regexp_replace(text, r"(?U)[\s ]+", " "))
    return F.regexp_replace(F.regexp_replace(out, r" +([,.;:)\]])", "$1"), r"^\.\s*(?=\()", "")


def fragments(quote: Column) -> Column:
    """Parts of a quotation between ellipses, canonical, without punctuation at their edges."""
    parts = F.transform(F.split(quote, ELLIPSIS), lambda x: F.btrim(canonical(x), F.lit(EDGE)))
    return F.filter(parts, lambda x: x != "")


def found_in_order(parts: Column, body: Column) -> Column:
    """Whether there are parts and each stands in body after the one before, without overlap."""

    def step(at: Column, part: Column) -> Column:
        place = F.call_function("locate", part, body, at)
        return F.when((at > 0) & (place > 0), place + F.length(part)).otherwise(0)

    return (F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def cache_key(model: Column, index: Column, question: Column) -> Column:
    folded = F.trim(F.regexp_replace(F.replace(F.lower(question), F.lit("ß"), F.lit("ss")), r"\s+", " "))
    return F.sha2(F.concat_ws("\0", model, index, folded), 256)


def section_number(raw: Column) -> Column:
    """Number of a cited section: up to the first bracket, the first digits with up to three letters, in upper case without blanks; null if none."""
    found = F.regexp_extract(F.split(raw, r"\(")[0], r"(?i)\d+\s*-?\s*[A-Z]{0,3}", 0)
    return F.nullif(F.upper(F.regexp_replace(found, r"\s+", "")), F.lit(""))


def source_code(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("schedule"), "ScheduleII").when(low.contains("upload") | low.contains("document"), "Uploaded").when(low.contains("penal"), "PenalCode").otherwise("CrPC")


def _state(cell: Column, yes: str, no: str) -> Column:
    known = F.when(F.trim(cell) == "", "unknown").when(cell.rlike(r"(?i)accor[- ]?ding\s+as|\bditto\b"), "depends")
    return known.when(cell.rlike(no), "no").when(cell.rlike(yes), "yes").otherwise("unknown")


def four_state(cell: Column, word: str | None = None) -> Column:
    """yes, no, depends or unknown of a table cell, by the first rule that fits. word: what the column is about; without it, arrest without warrant."""
    if word:
        return _state(cell, rf"(?i)\b{word}", rf"(?i)\bnot\s+{word}")
    return _state(cell, r"(?i)\bmay\s+arrest\b", r"(?i)\b(?:shall\s+not|may\s+not)\s+arrest\b")


def cell(text: Column) -> Column:
    """A table cell without marks of amendment and omission."""
    out = F.regexp_replace(F.regexp_replace(text, r"\s*\[?\s*\*\s*\*\s*\*\s*\]?\s*", " "), r"\d*\[|\]", "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def headword(phrase: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.split(phrase, r"(?i)[.,;]| if | when | where ", 2)[0]), r"\s+", " "))


def significant(phrase: Column) -> Column:
    """Whether a phrase of four characters or more has a word that isn't a stopword."""
    words = F.regexp_extract_all(phrase, F.lit(r"([a-z]+)"), F.lit(1))
    return (F.length(phrase) >= 4) & F.exists(words, lambda w: ~w.isin(STOPWORDS.split()))


def operation(note: Column) -> Column:
    """First of the operations, in their order, that an amendment note names as a word."""
    return F.coalesce(*[F.when(note.rlike(rf"(?i)\b{word}\b"), word) for word in OPERATIONS], F.lit("unknown"))


def effective_from(note: Column) -> Column:
    """Date of "with effect from ...)"; null for none or one that doesn't exist."""
    said = F.regexp_extract(note, r"(?i)with effect from\s+([^)]+?)\s*\)", 1)
    part = lambda i: F.regexp_extract(said, r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(\d{4})", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS.split())), F.lower(part(2)))
    return F.try_to_date(F.format_string("%s-%02d-%s", part(3), F.when(month > 0, month).cast("int"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def act_number(note: Column) -> Column:
    return F.nullif(clean(F.regexp_extract(note, ACT_NUMBER, 1)), F.lit(""))


def act_number_of_page(text: Column) -> Column:
    """Number of an act from the head of its page."""
    return F.nullif(clean(F.regexp_extract(clean(F.substring(text, 1, HEADER)), HEAD_NUMBER, 1)), F.lit(""))


def title(heading: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(clean(heading), r"^\d+\s+(?=[A-Z])", ""), F.lit("")), F.lit("Unknown Act"))


def role(title: Column, override: Column | None = None) -> Column:
    found = F.when(title.rlike(r"(?i)\(\s*amend(ment|ing)\s*\)"), "amending").otherwise("operative")
    return found if override is None else F.coalesce(override, found)


def daily_limit(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, DAILY)), lambda m: low.contains(m))


def asked_seconds(message: Column) -> Column:
    """Seconds of "try again in 1h2m3s"; null without."""
    text = F.regexp_extract(F.coalesce(message, F.lit("")), r"try again in ([0-9hms.]+)", 1)
    unit = lambda u: F.aggregate(F.regexp_extract_all(text, F.lit(rf"([0-9.]+){u}"), F.lit(1)), F.lit(0.0), lambda a, x: a + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return F.when(text != "", unit("h") * 3600 + unit("m") * 60 + unit("s"))


def retry_seconds(message: Column, default: float = 600.0, most: float = 1800.0) -> Column:
    """Wait that a rate-limit message asks for, with 15 seconds on top, from 30 to most; default without one."""
    asked = asked_seconds(message)
    return F.when(asked.isNull(), F.lit(default)).otherwise(F.least(F.lit(most), F.greatest(F.lit(30.0), asked + 15)))


def reset_hint(message: Column) -> Column:
    minutes = F.floor(F.floor(retry_seconds(message, 0.0)) / 60)
    hours = F.floor(minutes / 60)
    return F.when(retry_seconds(message, 0.0) <= 0, "").when(hours > 0, F.concat(F.lit("about "), hours, F.lit("h "), minutes % 60, F.lit("m"))).otherwise(F.concat(F.lit("about "), F.greatest(F.lit(1), minutes), F.lit(" minutes")))


def failure_status(message: Column) -> Column:
    """503 where waiting helps (a daily allowance, no connection), else 502."""
    low = F.lower(message)
    return F.when(daily_limit(message) | F.exists(F.array(*map(F.lit, UNREACHABLE)), lambda m: low.contains(m)), 503).otherwise(502)


# What a reader is told of a failure.
SPENT = "The shared free-tier daily token allowance for the hosted model is spent."
STILL = " Nothing is broken: the corpus, retrieval and the citation checks are all local and still working, and an answer would be grounded exactly as the others are."
SWITCH = " You can switch to the local model below and keep going — it is free and unmetered, and materially weaker."
WAIT = " This deployment has no second model to fall back to — a local one would re-fetch its weights on every cold start and answer in minutes on shared CPU — so waiting is genuinely the faster option."
UNREACHED, UNAVAILABLE = "The language model could not be reached: ", "The language model is unavailable: "
LOCAL = " The local model is running and can answer instead."


def failure_message(message: Column, local: Column) -> Column:
    """What a reader is told of a failure. local: whether a local model could answer instead."""
    said = F.coalesce(message, F.lit(""))
    hint = reset_hint(said)
    when = F.when(hint != "", F.concat(F.lit(" It frees up in "), hint, F.lit("."))).otherwise("")
    spent = F.concat(F.lit(SPENT), when, F.lit(STILL), F.when(local, SWITCH).otherwise(WAIT))
    unreached = F.concat(F.lit(UNREACHED), said, F.when(local, LOCAL).otherwise(""))
    return F.when(daily_limit(said), spent).when(failure_status(said) == 503, unreached).otherwise(F.concat(F.lit(UNAVAILABLE), said))


def caller(forwarded: Column, host: Column) -> Column:
    """Whom a request counts for: the first forwarded address, else the host."""
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), host, F.lit("unknown"))


def ratio(n: Column, d: Column) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 4)
