"""Quality rules, with DataFrame functions only: countable rules on every text and a hashed n-gram
log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of words are hashed into BUCKETS; two smoothed multinomials are counted over
them, one from the trusted rows and one from every row of the corpus. A document's verdict is the mean log
ratio of its n-grams against one threshold: the TRUSTED_LOSS quantile of the trusted rows' own
means, so all documents are judged alike and reruns agree.

Cases: a null or empty text has no words and fails the base rules. Without trusted rows the
ratio is 0 everywhere and the base rules alone decide. Equal texts get equal verdicts; null ids are never trusted, repeated rows get a row each. A very long text is
one row like any other. Input columns other than the named ones are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialise

BUCKETS = 1 << 13
#: The threshold is found to within 1 / STEPS of the ratio, from a histogram of all trusted rows.
STEPS = 1000
TRUSTED_LOSS = 0.003
SMOOTHING = 1.0
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def with_words(docs: DataFrame, text_column: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.withColumn("words", F.filter(F.split(text, BLANK), lambda w: w != ""))


def ngrams() -> F.Column:
    """Buckets of the unigrams and bigrams of the column words."""
    words = F.col("words")
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, F.filter(two, lambda b: b.isNotNull()))


def counts(docs: DataFrame) -> dict[int, int]:
    """n-grams by bucket over all rows; at most BUCKETS numbers reach the driver."""
    grams = with_words(docs).select(F.explode(ngrams()).alias("bucket"))
    return {r["bucket"]: r["count"] for r in grams.groupBy("bucket").count().collect()}


def log_ratios(target: dict[int, int], raw: dict[int, int]) -> list[float]:
    if not target:
        return [0.0] * BUCKETS
    t, r = sum(target.values()) + SMOOTHING * BUCKETS, sum(raw.values()) + SMOOTHING * BUCKETS
    return [round(math.log((target.get(b, 0) + SMOOTHING) / t) - math.log((raw.get(b, 0) + SMOOTHING) / r), 6) for b in range(BUCKETS)]


def with_score(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds llr: the mean log ratio of a document's n-grams, 0 without any. Needs the column words."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    docs = docs.withColumn("grams", ngrams())
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return docs.withColumn("llr", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)).drop("grams")


def threshold(trusted: DataFrame) -> float | None:
    """The largest step of the ratio that TRUSTED_LOSS of the trusted rows at most lie below; null without rows."""
    steps = {r["step"]: r["count"] for r in trusted.groupBy(F.floor(F.col("llr") * STEPS).alias("step")).count().collect()}  # the ratio is bounded, so its steps are
    lost, rows = 0, sum(steps.values())
    for step in sorted(steps):
        if lost + steps[step] > TRUSTED_LOSS * rows:
            return step / STEPS
        lost += steps[step]
    return None


def with_rules(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds the base counts. Needs the column words."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    n = F.size("words")
    docs = docs.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(text, _WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "lines": lines,
        "windows": F.when(n >= 3, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.xxhash64(F.get("words", i - 2), F.get("words", i - 1), F.get("words", i)))).otherwise(F.array().cast("array<long>")),
    })
    docs = docs.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "repeats": F.size("windows") > F.size(F.array_distinct("windows")),
    })
    # windows in order of their hash beside their place: equal ones are neighbours
    docs = docs.withColumn("ordered", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda j: F.get("ordered", j)["h"]
    twice = F.filter("ordered", lambda x, j: F.coalesce(x["h"] == at(j + 1), F.lit(False)) | (F.coalesce(x["h"] == at(j - 1), F.lit(False)) & (j > 0)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return docs.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long")).drop("lines", "windows", "ordered", "repeats")


def quality(docs: DataFrame, trusted_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document with the base counts, base_failed, llr and kept.

    trusted_ids: one column of ids of trusted rows.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    ids = trusted_ids.select(trusted_ids[trusted_ids.columns[0]].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = materialise(docs.join(ids.hint("merge"), "doc_id", "left_semi"), "trusted")  # ids grow with the rows, so they go to no task whole at any size
    ratios = log_ratios(counts(trusted), counts(docs))
    floor = threshold(with_score(with_words(trusted), ratios).where(F.size("words") >= MIN_WORDS))
    out = with_score(with_rules(with_words(docs)), ratios)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= F.lit(floor if floor is not None else -math.inf))).alias("kept"), "llr")
