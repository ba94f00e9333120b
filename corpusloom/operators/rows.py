"""Order-dependent row operators: sections from rows, carried headings, ditto cells, records of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: str, order: str, start: Column) -> DataFrame:
    """Adds section_ord: how many starts a group has seen; rows before its first go."""
    seen = F.sum(F.when(start, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("section_ord", seen.cast("long")).where("section_ord > 0")


def carried(rows: DataFrame, group: str, order: list[str], part: Column, chapter: Column, heading: Column) -> DataFrame:
    """Adds part, chapter, heading in force at each row: a new part ends chapter and heading, a new chapter ends the heading."""
    window = Window.partitionBy(group).orderBy(*order)
    rows = rows.withColumns({"_p": part, "_c": chapter, "_h": heading}).withColumn("_part_no", F.count("_p").over(window))
    in_part = Window.partitionBy(group, "_part_no").orderBy(*order)
    rows = rows.withColumns({"part": F.last("_p", True).over(window), "chapter": F.last("_c", True).over(in_part), "_chapter_no": F.count("_c").over(in_part)})
    in_chapter = Window.partitionBy(group, "_part_no", "_chapter_no").orderBy(*order)
    return rows.withColumn("heading", F.last("_h", True).over(in_chapter)).drop("_p", "_c", "_h", "_part_no", "_chapter_no")


def dittos(rows: DataFrame, group: str, order: str, value: Column, is_ditto: Column) -> DataFrame:
    """Adds resolved: a ditto takes the value before it; with none, the first ditto's own text."""
    window = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumns({"_v": value, "_d": is_ditto}).withColumn("_g", F.sum(F.when(F.col("_d"), 0).otherwise(1)).over(window))
    run = Window.partitionBy(group, "_g")
    base = F.max(F.when(~F.col("_d"), F.col("_v"))).over(run)
    first = F.min_by("_v", F.when(F.col("_d"), F.col(order))).over(run)
    return rows.withColumn("resolved", F.when(~F.col("_d"), F.col("_v")).when(F.coalesce(base, F.lit("")) != "", base).otherwise(first)).drop("_v", "_d", "_g")


def joined(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """One text for each group: pieces in order, after a hyphen without it, else after a blank."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    fold = F.aggregate(pieces, F.lit(""), lambda a, p: F.when(a == "", p).when(a.endswith("-"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), p)).otherwise(F.concat(a, F.lit(" "), p)))
    return rows.groupBy(group).agg(fold.alias("joined"))
