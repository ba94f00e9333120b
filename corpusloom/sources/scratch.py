"""Tables that a plan writes on its way, and checks that run whatever a caller reads."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares; unset, a temporary one for a local master alone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        top = _local[app] = _local.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-corpusloom-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to a shared folder and read back: computed once, and not again where an executor is lost."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), dealt by key, so that joins on it shuffle the other side alone. dropped() deletes it."""
    spark = df.sparkSession
    n, path, table = int(spark.conf.get("spark.sql.shuffle.partitions")), folder(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    found = spark.table(table)
    found.bucketed_as = table, path
    return found


def dropped(df: DataFrame) -> None:
    """Deletes a bucketed table, and the shuffles that nothing refers to any more, which Spark does when the driver's garbage is collected."""
    spark, (table, path) = df.sparkSession, df.bucketed_as
    spark.sql(f"DROP TABLE {table}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    for _ in range(2):  # Python's handles go first, what they held is found next
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Few rows in an Arrow batch, so that whole texts and pages don't fill a worker's memory, however many rows its partition has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")


def asserted(df: DataFrame, broken: Column, *said: Column | str) -> DataFrame:
    """df, after a job that fails with the first of its rows for which broken holds, in words of said. It runs here, so that no choice of columns prunes it."""
    bad = df.where(F.coalesce(broken, F.lit(False))).select(F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in said)).alias("said")).first()
    if bad:
        raise ValueError(bad["said"])
    return df


def names(df: DataFrame, *wanted: str) -> list[str]:
    """For each of wanted a column name that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
