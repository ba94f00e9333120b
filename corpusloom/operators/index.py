"""Vector index: models, building, exact nearest vectors, fingerprints, differences between two states, churn.

Rows without a vector, with a null in it or of another length than a query's take no part in its search. Equal vectors are ranked by id, repeated rows
count each. Empty tables give empty results. Columns of chunks that aren't named come along, whatever their names, where rows are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import asserted, names, written

#: Bytes of the query vectors that one pass of an exact search compares with all vectors.
QUERY_BYTES = 16 << 20
#: Vectors and queries of one product of matrices.
AT_ONCE, SIDE = 2048, 512
BATCH = 32


class Model(NamedTuple):
    """An embedding model: its name, the length of its vectors, and load, which a worker calls once for a function from texts to vectors."""

    name: str
    size: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]


def embedding(text: Column, model: Model) -> Column:
    """A model's vector of a text, of length 1 (a zero vector stays): texts of a batch go to the model by length, BATCH at a time.

    A model that gives other than one vector of its size for each text, or numbers that aren't finite, is an error. A null text counts as empty.
    """
    name, size, load = model

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out = np.zeros((len(texts), size), dtype=np.float32)
            for begin in range(0, len(order), BATCH):
                at = order[begin : begin + BATCH]
                found = np.asarray(encode([texts[i] for i in at]), dtype=np.float32)
                if found.shape != (len(at), size) or not np.isfinite(found).all():
                    raise ValueError(f"{name} gave vectors of shape {found.shape} for {len(at)} texts, or such as aren't finite; its size is {size}")
                out[at] = found
            length = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(length > 0, length, 1)), index=part.index)

    return run(text)


def hashing(size: int = 64) -> Model:
    """A model without weights: hashed words."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import re

        word = re.compile(r"\w+")

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), dtype=np.float32)
            for i, text in enumerate(texts):
                for w in word.findall(text.lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % size] += 1 if h >> 63 else -1
            return out

        return encode

    return Model(f"hashed-words-{size}", size, load)


def build(chunks: DataFrame, model: Model, text: str = "embedding_text") -> DataFrame:
    """Chunks with the vector of what is embedded of each."""
    return chunks.withColumn("vector", embedding(F.col(text), model))


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of that size as rows, and which of the column they are."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.ones(len(lengths), dtype=bool)
    good[row[np.isnan(flat)]] = False
    good &= lengths == size
    return flat[good[row]].reshape(-1, size), np.flatnonzero(good)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, their terms added in order, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _first(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, score, id): the k best of each query."""
    q, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = place < k
    return q[keep], score[keep], ids[keep]


def _nearest(batches: Iterator[pa.RecordBatch], asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """place of the query, vec_id and score of the k best of this task's vectors."""
    best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    size = np.abs(asked).sum(axis=1, keepdims=True)
    for batch in batches:
        for begin in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(begin, AT_ONCE)
            vectors, at = _matrix(part[1], asked.shape[1])
            if not len(vectors):
                continue
            ids = part[0].to_numpy()[at]
            slack = 1e-12 * np.abs(vectors).max(initial=0)  # products of matrices add up in another order
            found = [best]
            for first in range(0, len(asked), SIDE):
                some = asked[first : first + SIDE]
                scores = some @ vectors.T
                least = np.partition(scores, -min(k, len(vectors)), axis=1)[:, -min(k, len(vectors)), None] - slack * size[first : first + SIDE]
                q, v = np.nonzero(scores >= least)
                found.append((q + first, _summed(some[q], vectors[v]), ids[v]))
            best = _first(found, k)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best[0], best[2], best[1])], ["place", "vec_id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, score of the k best vectors of each query (qid, qvec); ties by id.

    Queries go to the tasks in blocks of QUERY_BYTES at most, whatever their number, and meet the vectors as products of matrices; a task keeps the k best of a query before anything is
    shuffled. With more than one block the rows of each are written before the next begins.
    """
    spark = queries.sparkSession
    asked = queries.where(F.size("qvec") > 0).where(F.forall("qvec", lambda x: x.isNotNull())).select("qid", F.col("qvec").cast("array<double>").alias("qvec"), F.size("qvec").alias("size"))
    kinds = asked.groupBy("size").count().collect()  # lengths of vectors
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, vec_id long, score double"
    found = []
    for row in sorted(kinds):
        blocks = -(-row["count"] * row["size"] * 8 // QUERY_BYTES)
        for i in range(blocks):
            block = asked.where((F.col("size") == row["size"]) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).select("qid", "qvec").toArrow().combine_chunks()
            matrix, at = _matrix(block["qvec"].combine_chunks(), row["size"])
            numbers = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(matrix))), "qid": block["qid"].take(pa.array(at))}).combine_chunks())
            near = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(lambda b, m=matrix: _nearest(b, m, k), "place long, vec_id long, score double")
            rows = near.join(F.broadcast(numbers), "place").select("qid", "vec_id", "score")  # a block's ids
            found.append(written(rows, "nearest") if len(kinds) > 1 or blocks > 1 else rows)
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")


def fingerprint(chunks: DataFrame, group: str, id_column: str, hash_column: str) -> DataFrame:
    """group, fp12: SHA-256 over (id, hash) in order. A group's sorted rows stream through one running hash."""
    rows = chunks.select(F.col(group).alias("group"), F.col(id_column).cast("string").alias("id"), F.col(hash_column).alias("h")).na.fill("", ["id", "h"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([running.hexdigest()[:12]])], [group, "fp12"])
        for batch in batches:
            for g, i, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if running is None or g != key:
                    if running is not None:
                        yield row()
                    key, running = g, hashlib.sha256()
                running.update(f"{i}\0{h}\0".encode())
        if running is not None:
            yield row()

    return rows.repartition("group").sortWithinPartitions("group", "id", "h").mapInArrow(digests, f"{group} string, fp12 string")


def digest(chunks: DataFrame, group: list[str], id_column: str, hash_column: str) -> DataFrame:
    """group, n, digest: of a state's (id, hash) in any order, by sums over the four words of each row's SHA-256, so that a group of any size is combined before it is shuffled."""
    row = F.sha2(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(hash_column, F.lit("")), F.lit("\0")), 256)
    word = lambda i: F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(word(i)).alias(f"w{i}") for i in range(4)]
    found = chunks.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    return found.select(*group, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.col(f"w{i}").cast("string") for i in range(4))), 256).alias("digest"))


def shape(chunks: DataFrame) -> DataFrame:
    """document, strategies (without the rows of tables, sorted), with_schedule of chunks (document, strategy); more than one strategy is an error, whatever is read of the result."""
    main = F.array_sort(F.collect_set(F.when(F.col("strategy") != "schedule_rows", F.col("strategy"))))
    found = chunks.groupBy("document").agg(main.alias("s"), F.bool_or(F.col("strategy") == "schedule_rows").alias("with_schedule"))
    asserted(found, F.size("s") > 1, "mixed strategies in", F.col("document"))
    return found.select("document", F.array_join("s", ",").alias("strategies"), "with_schedule")


def desired(acts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks (act_id, ...) of acts (act_id, role) that are operative."""
    return chunks.join(acts.where("role = 'operative'").select("act_id"), "act_id", "left_semi")


def converge(old: DataFrame, new: DataFrame, embed: Column | Model, text: str = "embedding_text") -> DataFrame:
    """The next state of an index: rows of new (chunk_id, content_hash, more) with old's vector where the hash is the same, else a new one; reused says which.

    Facts of unchanged chunks are those of new. embed: a model, which sees the texts of added and changed chunks only, or a column. In order, an index lists its reused chunks first.
    An id that comes twice in either state is an error.
    """
    for rows, said in ((old, "the index"), (new, "the desired chunks")):
        asserted(rows.groupBy("chunk_id").agg(F.count("*").alias("times")), F.col("times") > 1, F.col("chunk_id"), "comes twice in", said)
    was, kept, same = names(new, "was_hash", "was_vector", "is_same")
    held = old.select("chunk_id", F.col("content_hash").alias(was), F.col("vector").alias(kept))
    both = new.join(held, "chunk_id", "left").withColumn(same, F.coalesce(F.col(was) == F.col("content_hash"), F.lit(False)))
    if isinstance(embed, Column):
        return both.select(*new.columns, F.when(F.col(same), F.col(kept)).otherwise(embed).alias("vector"), F.col(same).alias("reused"))
    reused = both.where(F.col(same)).select(*new.columns, F.col(kept).alias("vector"), F.lit(True).alias("reused"))
    return reused.unionByName(both.where(~F.col(same)).select(*new.columns, embedding(F.col(text), embed).alias("vector"), F.lit(False).alias("reused")))


def amended(chunks: DataFrame, section: str, text: str, order: str = "chunk_id") -> DataFrame:
    """Chunks as they are after the first chunk of a section got another text; a section that isn't there is an error."""
    found = chunks.where(F.col("section_number") == section).agg(F.min(order).alias("first")).first()["first"]
    if found is None:
        raise ValueError(f"section {section} isn't among the chunks")
    return chunks.withColumn("text", F.when((F.col("section_number") == section) & (F.col(order) == F.lit(found)), F.lit(text)).otherwise(F.col("text")))


def report(states: DataFrame) -> DataFrame:
    """embedded, total, summary of the states of diff()."""
    found = states.agg(F.count_if(F.col("status").isin("added", "changed")).alias("embedded"), F.count_if(F.col("status") != "removed").alias("total"))
    share = F.try_divide(100 * (F.col("total") - F.col("embedded")), F.col("total"))
    shown = F.when((share > 99.5) & (F.col("embedded") > 0), F.format_string("%.1f", share)).otherwise(F.format_string("%.0f", share))
    return found.withColumn("summary", F.concat(F.lit("embedded "), "embedded", F.lit(" of "), "total", F.lit(" chunks ("), shown, F.lit("% reused)")))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and status (added, removed, changed, unchanged) between two states (id, hash)."""
    both = old.select("id", F.col("hash").alias("was")).join(new.select("id", F.col("hash").alias("now")), "id", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return both.select("id", status.alias("status"))


def churn(found: DataFrame, most: float = 0.25) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    before = n("removed") + n("changed") + n("unchanged")
    share = F.when(before == 0, 1.0).otherwise((n("added") + n("removed")) / before)
    return found.agg(n("added").alias("added"), n("removed").alias("removed"), F.round(share, 4).alias("churn"), (share > most).alias("refuse"))
