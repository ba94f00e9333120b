"""Versions of an index on storage: each is a manifest of data folders, published at once, and folders that didn't change are shared.

Chunks are dealt by a hash of chunk_id to parts; their number is fixed when an index is made. A converge writes the parts that differ and lists
the old folders of the others. A manifest is written aside and renamed to its number, which one writer alone can do: who comes
second finds the number taken and nothing of the index has changed. A write that breaks leaves folders that no manifest lists.

Cases: an index of no chunks has a version with no folders. An id that comes twice is an error, before anything is written. Chunks keep all their columns; `part` is the store's own.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import index
from corpusloom.sources.scratch import asserted, written

PARTS = 64
MOST_CHURN = 0.25


class Refused(ValueError):
    """A change that is a rebuild, or that another writer was ahead of."""


class Version(NamedTuple):
    """number; parent (0: none); model; size of its vectors; parts: how many; folders: of each part that has rows; count and fingerprint of the chunks; schema as DDL; note."""

    number: int
    parent: int
    model: str
    size: int
    parts: int
    folders: dict[str, str]
    count: int
    fingerprint: str
    schema: str
    note: str


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _name(path: str, number: int) -> str:
    return f"{path}/manifests/{number:06d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, rising."""
    files, at = _files(spark, path)
    folder = at(f"{path}/manifests")
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version, the newest without a number; None where there is none yet."""
    known = versions(spark, path)
    if number is None and not known:
        return None
    text = "".join(r.value for r in spark.read.text(_name(path, known[-1] if number is None else number), wholetext=True).collect())
    return Version(**json.loads(text))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The chunks of a version with their vectors; an error where rows are missing or too many."""
    found = version(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"no version of an index at {path}")
    if not found.folders:
        return spark.createDataFrame([], found.schema)
    rows = spark.read.schema(found.schema).parquet(*(f"{path}/{f}" for f in found.folders.values()))
    if (n := rows.count()) != found.count:
        raise ValueError(f"version {found.number} at {path} has {n} rows, not the {found.count} that were published")
    return rows


def _publish(spark: SparkSession, path: str, found: Version) -> Version:
    files, at = _files(spark, path)
    aside, name = at(f"{path}/manifests/.{uuid.uuid4().hex}"), at(_name(path, found.number))
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(found._asdict(), sort_keys=True).encode()))
    stream.close()
    if files.exists(name) or not files.rename(aside, name):
        files.delete(aside, False)
        raise Refused(f"version {found.number} at {path} is another writer's")
    return found


def _part(parts: int):
    return F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")


def _fingerprint(rows: DataFrame) -> tuple[int, str]:
    found = index.digest(rows.withColumn("part", F.lit(0)), ["part"], "chunk_id", "content_hash").first()
    return (found["n"], found["digest"][:12]) if found else (0, "")


def _write(rows: DataFrame, path: str, parts: int, only: list[int] | None = None) -> dict[str, str]:
    """Writes the rows of the parts (all without only), a folder for each; those that have rows."""
    spark, data = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn("part", _part(parts))
    if only is not None:
        dealt = dealt.where(F.col("part").isin(only))
    dealt.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/{data}")
    files, at = _files(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(at(f"{path}/{data}")) if x.isDirectory()]
    return {n.removeprefix("part="): f"{data}/{n}" for n in names if n.startswith("part=")}


def create(chunks: DataFrame, path: str, model: index.Model, parts: int = PARTS, note: str = "created") -> Version:
    """The first version of an index: chunks (chunk_id, embedding_text, content_hash, more), all of them embedded."""
    spark = chunks.sparkSession
    if version(spark, path):
        raise Refused(f"there is an index at {path}")
    asserted(chunks.groupBy("chunk_id").agg(F.count("*").alias("times")), F.col("times") > 1, F.col("chunk_id"), "comes twice")
    rows = written(index.build(chunks, model), "embedded")
    count, fingerprint = _fingerprint(rows)
    return _publish(spark, path, Version(1, 0, model.name, model.size, parts, _write(rows, path, parts), count, fingerprint, _ddl(rows), note))


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def converge(desired: DataFrame, path: str, model: index.Model, force: bool = False, dry: bool = False, note: str = "converged") -> tuple[Version | None, dict]:
    """The next version, in which the index holds the desired chunks; only added and changed ones are embedded.

    Returns the version (none for a dry run) and the report: added, changed, unchanged, removed, churn. More churn than MOST_CHURN is refused without force, as is another model.
    """
    spark = desired.sparkSession
    old = version(spark, path)
    if old is None:
        raise FileNotFoundError(f"no version of an index at {path}; create it first")
    if model.name != old.model or model.size != old.size:
        raise Refused(f"the index was made with {old.model}, not {model.name}")
    held = read(spark, path, old.number)
    state = lambda rows: rows.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("hash"))
    found = index.diff(state(held), state(desired))
    report = {"added": 0, "changed": 0, "unchanged": 0, "removed": 0} | {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    before = old.count
    report["churn"] = (report["added"] + report["removed"]) / before if before else 1.0
    if report["churn"] > MOST_CHURN and not force:
        raise Refused(f"this would add {report['added']} and remove {report['removed']} of {before} chunks, which is a rebuild")
    if dry:
        return None, report
    rows = written(index.converge(held, desired, model).drop("reused"), "converged")
    # parts whose rows differ in anything, facts of unchanged chunks included
    listed = lambda df: df.withColumn("part", _part(old.parts)).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[c for c in rows.columns if c != "vector"]).cast("decimal(38,0)")).alias("of_rows"))
    if set(held.columns) == set(rows.columns):
        a, b = listed(held), listed(rows)
        same = [r["part"] for r in a.join(b, ["part", "n", "of_rows"]).select("part").collect()]  # numbers of parts
    else:
        same = []
    changed = [p for p in range(old.parts) if p not in same]
    folders = {str(p): old.folders[str(p)] for p in same} | _write(rows, path, old.parts, changed)
    count, fingerprint = _fingerprint(rows)
    return _publish(spark, path, Version(old.number + 1, old.number, model.name, model.size, old.parts, folders, count, fingerprint, _ddl(rows), note)), report


def revert(spark: SparkSession, path: str, number: int) -> Version:
    """A new version that lists what version number listed; nothing is written but its manifest."""
    then, now = version(spark, path, number), version(spark, path)
    return _publish(spark, path, then._replace(number=now.number + 1, parent=now.number, note=f"reverted to {number}"))
