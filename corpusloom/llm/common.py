"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words in most contracts, as a Java regular expression class.
BLANK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't fill a worker's memory; let workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    # workers give freed memory back instead of keeping it for later
    for name, value in (("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "1000000"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares.

    Where that is unset, a temporary folder will do for a local master alone; on a cluster other machines wouldn't see it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-corpusloom-")
        _local[spark.sparkContext.applicationId] = top
    return f"{top}/{name}-{uuid.uuid4().hex}"


_local: dict[str, str] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected."""
    for _ in range(2):  # Python's handles go first, what they held is found next
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more, and the shuffles behind them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """A materialised table that joins on key without being shuffled again. dropped() deletes it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"scratch_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", scratch(spark, name))
    writer.bucketBy(n, key).saveAsTable(table)
    found = spark.table(table)
    found.bucketed_as = table
    return found


def dropped(df: DataFrame) -> None:
    """Deletes a bucketed table: its files and its name in the catalogue."""
    discard(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.bucketed_as}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


# Prefix polynomial hashes over bytes, modulo 2^64. Bytes go through a fixed table of random
# 64-bit numbers first, so that low bits are as good as high ones.

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> list[np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        found = _powers[base] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
    return [x[:n] for x in found]


def prefix_hashes(raw: np.ndarray, table: np.ndarray = _TABLE, base: int = _BASE) -> np.ndarray:
    """P with P[j] - P[i] the hash of raw[i:j] times base^i."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(table[raw] * powers(len(raw), base)[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Mixed hashes of the spans [start, end)."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
