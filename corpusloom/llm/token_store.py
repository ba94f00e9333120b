"""Token-id output: a content-addressed store of chunks of ids.

Format. A store is a folder with three Parquet tables:
chunks (address, blob): each distinct chunk once; blob is the width of an id in bytes (2 or 4), then the
little-endian ids; address is the SHA-256 of blob.
recipes (shard, doc_id, start, n_tokens, addresses, lengths, root): documents in ascending doc_id order, shard by
shard; start counts the shard's ids before it; root is the Merkle root of its addresses.
manifest (shard, first, n_docs, n_tokens, root): first counts all ids before the shard; root is the
Merkle root of its documents' roots in order.

Chunks end where a rolling hash of the last WINDOW ids says so, so equal passages become equal chunks
wherever they stand. Reading verifies every address, length and root, and raises on a difference; read_ids puts the ids of each document
together again, read_store their number and checksum, which follow from those of the chunks.

Cases: a null text is as an empty one: its only id is the end id. Repeated rows and doc_ids keep a recipe each,
in the order of their roots; null doc_ids come first. A very long text has as many chunks as it needs, and one recipe. An empty table gives an empty store.
Columns beside the named ones are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, scratch, text_bytes
from .tokens import encoder, gathered

END_ID = 2
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STAGED = "doc_id long, n_tokens long, addresses array<binary>, lengths array<int>, root binary, blobs array<binary>"
_RECIPE = "shard int, doc_id long, start long, n_tokens long, addresses array<binary>, lengths array<int>, root binary"


def cuts(flat: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each id stream, within it; the streams lie in flat between bounds."""
    marks = np.zeros(0, dtype=np.int64)
    if len(flat) >= WINDOW:
        with np.errstate(over="ignore"):
            terms = mix(flat.astype(np.uint64) + np.uint64(1))
            width, base, rolling = 1, _BASE, terms  # WINDOW and MEAN are powers of two
            while width < WINDOW:
                rolling = rolling[:-width] * base + rolling[width:]
                width, base = 2 * width, base * base
            marks = np.flatnonzero(mix(rolling) & np.uint64(MEAN - 1) == 0) + WINDOW
    first, last_ = np.searchsorted(marks, bounds[:-1] + LEAST), np.searchsorted(marks, bounds[1:])
    out = []
    for start, n, i, j in zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), first.tolist(), last_.tolist(), strict=True):
        ends, last = [], 0
        for end in (marks[i:j] - start).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while n - last > MOST:
            last += MOST
            ends.append(last)
        out.append([*ends, n])
    return out


def blob(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def ids_of(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype=f"<u{stored[0]}", offset=1).astype("<u4")


class Merkle:
    """Root over leaves as they come: pairs are hashed level by level, an odd one goes up as it is. Holds one hash for each level."""

    def __init__(self):
        self.held: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\x00" + leaf).digest()
        while self.held and self.held[-1][0] == level:
            node = hashlib.sha256(b"\x01" + self.held.pop()[1] + node).digest()
            level += 1
        self.held.append((level, node))

    def root(self) -> bytes:
        if not self.held:
            return hashlib.sha256(b"").digest()
        node = self.held[-1][1]
        for _, left in reversed(self.held[:-1]):
            node = hashlib.sha256(b"\x01" + left + node).digest()
        return node


def merkle(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _staged(batches: Iterator[pa.RecordBatch], end_id: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    words = encoder(vocabulary)
    for some in gathered(batches, 1):
        all_, until = words.encode_flat(some[1])
        until = np.concatenate([[0], until])
        for at in range(0, some.num_rows, 250):
            batch, ends = some.slice(at, 250), until[at : at + 251]
            flat = np.insert(all_[ends[0] : ends[-1]], ends[1:] - ends[0], np.uint32(end_id))
            bounds = ends - ends[0] + np.arange(len(ends))
            addresses, lengths, roots, blobs = [], [], [], []
            for start, stops in zip(bounds.tolist(), cuts(flat, bounds), strict=False):
                mine = [blob(flat[start + a : start + b]) for a, b in zip([0, *stops], stops, strict=False)]
                blobs.append(mine)
                addresses.append([hashlib.sha256(x).digest() for x in mine])
                lengths.append([b - a for a, b in zip([0, *stops], stops, strict=False)])
                roots.append(merkle(addresses[-1]))
            columns = (np.diff(bounds), addresses, lengths, roots, blobs)
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "addresses", "lengths", "root", "blobs"])
    words.rest()


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a partition's sorted recipes: its shard, and the ids before each."""
    shard, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        get = batch.column
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, dtype=np.int32)), get("doc_id"), pa.array(start), get("n_tokens"), get("addresses"), get("lengths"), get("root")], ["shard", "doc_id", "start", "n_tokens", "addresses", "lengths", "root"])


def write_store(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, vocabulary: str | None = None) -> None:
    spark = docs.sparkSession
    staged = docs.select(docs[id_column].cast("long"), text_bytes(text_column)).mapInArrow(lambda b: _staged(b, end_id, vocabulary), _STAGED)
    staged.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{path}/staged")
    # copies of a chunk meet before the shuffle first: a very common one is one row from each task
    chunks = staged.select(F.explode(F.arrays_zip("addresses", "blobs")).alias("x")).select(F.col("x.addresses").alias("address"), F.col("x.blobs").alias("blob"))
    chunks.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = staged.drop("blobs").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    recipes.mapInArrow(_sharded, _RECIPE).write.parquet(f"{path}/recipes")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    totals = recipes.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    manifest = totals.join(_roots(recipes), "shard").withColumn("first", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))  # a row for each shard
    manifest.select("shard", "first", "n_docs", "n_tokens", "root").write.parquet(f"{path}/manifest")


def _roots(recipes: DataFrame) -> DataFrame:
    """Each shard's Merkle root, of its documents' roots in order; the order statistic is (start, doc_id, root)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, Merkle()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([tree.root()], pa.binary())], ["shard", "root"])
        for batch in batches:
            for s, root in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if s != shard:
                    if shard is not None:
                        yield row()
                    shard, tree = s, Merkle()
                tree.add(root)
        if shard is not None:
            yield row()

    return recipes.repartition("shard").sortWithinPartitions("shard", "start").select("shard", "root").mapInArrow(rows, "shard int, root binary")


_shifts: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 becomes when n_bytes further bytes follow, before those bytes' own crc32 is added by xor."""
    if not _shifts:
        # images of the 32 bits under one zero byte, then squares of that map: 2^k zero bytes
        images = np.arange(32, dtype=np.uint64)
        images = np.uint64(1) << images
        for _ in range(8):
            images = np.where(images & np.uint64(1), images >> np.uint64(1) ^ np.uint64(0xEDB88320), images >> np.uint64(1))
        for _ in range(48):
            _shifts.append(images)
            images = _apply(images, images)
    out, left, k = crc.astype(np.uint64), n_bytes.astype(np.int64), 0
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _apply(_shifts[k], out[odd])
        left = left >> 1
        k += 1
    return out


def _apply(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for bit in range(32):
        out ^= np.where(values >> np.uint64(bit) & np.uint64(1), images[bit], np.uint64(0))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the number of ids behind it. Recipes are verified."""
    for batch in batches:
        shard, start, addresses, lengths, root, total = (batch.column(c) for c in ("shard", "start", "addresses", "lengths", "root", "n_tokens"))
        n = addresses.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lengths.flatten().to_numpy().astype(np.int64)
        if (lengths.value_lengths().to_numpy(zero_copy_only=False) != n).any():
            raise ValueError("a recipe has changed")
        for mine, said in zip(addresses.to_pylist(), root.to_pylist(), strict=True):
            if merkle(mine) != said:
                raise ValueError("a recipe has changed")
        until = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(n)
        if (until[last] - until[last - n] != total.to_numpy()).any():
            raise ValueError("a recipe has changed")
        row = np.repeat(np.arange(len(n)), n)
        after, i = until[last][row] - until[1:], np.arange(len(row)) - (last - n)[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([shard.take(take), batch.column("doc_id").take(take), start.take(take), addresses.flatten(), pa.array(sizes), pa.array(after), pa.array(i)], ["shard", "doc_id", "start", "address", "length", "after", "i"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """address, number of ids and crc32 of each chunk; chunks are verified."""
    for batch in batches:
        n, crc = [], []
        for address, stored in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            if hashlib.sha256(stored).digest() != address:
                raise ValueError(f"chunk {address.hex()} has changed")
            ids = ids_of(stored)
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch[0], pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "n", "crc"])


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks' places in the documents; each shard's first id. Roots of shards are verified."""
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    found = manifest.select("shard", "first", F.col("root").alias("said")).join(_roots(recipes), "shard", "left")
    first = found.select("shard", F.when(F.col("said").eqNullSafe(F.col("root")), F.col("first")).otherwise(F.raise_error(F.lit("a shard's recipes have changed"))).alias("first"))
    return recipes.mapInArrow(_parts, "shard int, doc_id long, start long, address binary, length long, after long, i long"), first


def _whole(value: F.Column) -> F.Column:
    return F.when(F.col("n") == F.col("length"), value).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Each document's doc_id, start among all ids, n_tokens and ids_crc32, from the verified files."""
    parts, first = _opened(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked, "address binary, n long, crc long")

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), after.to_numpy() * 4).astype(np.int64))

    digests = parts.join(chunks, "address", "left").groupBy("shard", "doc_id", "start").agg(F.sum(_whole(F.col("length"))).alias("n_tokens"), F.bit_xor(shifted(F.coalesce("crc", F.lit(0)), "after")).alias("ids_crc32"))
    return digests.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")  # first: a row for each shard


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Each document's doc_id, start among all ids, and ids, put together from the verified files."""
    parts, first = _opened(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    sizes = chunks.select("address", "blob").mapInArrow(_checked, "address binary, n long, crc long").select("address", "n")
    some = parts.join(chunks.join(sizes, "address"), "address", "left").select("shard", "doc_id", "start", F.struct("i", _whole(F.col("blob")).alias("blob")).alias("x"))
    rows = some.groupBy("shard", "doc_id", "start").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["blob"]).alias("blobs"))  # bounded by a document

    @F.pandas_udf("array<long>")
    def ids(blobs: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([ids_of(x) for x in some]).astype(np.int64) for some in blobs])

    return rows.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("start")).alias("start"), ids("blobs").alias("ids"))


def store_and_read(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(docs, path, **options)
    return read_store(docs.sparkSession, path)
