"""Reports of runs: coverage, percentages by model and stage, long form for charts, Markdown. Runs: model, stage, system, measured, questions, dataset_questions, missing_answers and rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(rate: str) -> Column:
    """A rate as a percentage of one decimal; the number's own binary value decides on its rounding, which format_string's doesn't."""

    @F.pandas_udf("string")
    def shown(rates: pd.Series) -> pd.Series:
        return rates.map(lambda x: "n/a" if pd.isna(x) else f"{x * 100:.1f}%").astype(object)

    return shown(F.col(rate).cast("double"))


def incomplete(runs: DataFrame, most: float = 0.05) -> DataFrame:
    return runs.withColumn("incomplete", F.col("errors") > most * F.col("questions"))


def coverage(runs: DataFrame) -> DataFrame:
    """model, note: whether a model's stages cover the same questions."""
    sizes, measured = F.collect_set(F.coalesce("dataset_questions", "questions")), F.collect_set("measured")
    found = runs.groupBy("model").agg(sizes.alias("s"), measured.alias("m"))
    one = F.col("s")[0].cast("string")
    note = F.when((F.size("s") == 1) & (F.size("m") == 1), F.concat(F.lit("same "), one, F.lit(" questions throughout, all measured"))).when(F.size("s") == 1, F.concat(one, F.lit("-question set; stages cover different parts of it — see the labels below")))
    return found.select("model", F.coalesce(note, F.lit("question counts differ between stages — see the labels below")).alias("note"))


def by_model(runs: DataFrame, rates: list[str]) -> DataFrame:
    """Rows in order of a model's stages, with coverage and percentages as text."""
    covered = F.concat("measured", F.lit("/"), "questions", F.when(F.col("missing_answers") > 0, F.concat(F.lit(" of "), "dataset_questions")).otherwise(""))
    place = F.row_number().over(Window.partitionBy("model").orderBy("stage")).cast("long")
    return runs.select("model", "stage", place.alias("place"), covered.alias("covered"), *(percent(r).alias(r) for r in rates))


def long_form(runs: DataFrame, rates: list[str]) -> DataFrame:
    """model, stage, metric, value; without a rate of fabrications, what isn't valid counts."""
    rows = runs.withColumn("fabrication_rate", F.coalesce("fabrication_rate", 1 - F.col("excerpt_validity")))
    return rows.select("model", "stage", *(F.col(r).cast("double").alias(r) for r in rates)).unpivot(["model", "stage"], rates, "metric", "value")


def markdown(table: DataFrame, order: list[str]) -> str:
    """A table of a report, which is small, as Markdown."""
    lines = ["| " + " | ".join(table.columns) + " |", "|---" * len(table.columns) + "|"]
    return "\n".join([*lines, *("| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in table.orderBy(*order).toLocalIterator())])


def console(table: DataFrame, order: list[str]) -> str:
    """The same, aligned."""
    rows = [table.columns, *([str(v) for v in r] for r in table.orderBy(*order).toLocalIterator())]
    width = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows)
