"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays over code points answer whether any two spans are equal, and a binary search over them
gives longest common extensions (PrefixHashes). A fingerprint keeps a bounded choice of them: the hash of
the whole text, and hashes of the prefixes and suffixes whose lengths are multiples of a step, the
smallest power of two that leaves at most MARKS of them. Steps of two texts nest, so the longest common prefix
and suffix of two texts are found to within a step from their fingerprints alone; edited_prefix and edited_suffix
are their exact lengths for a text and its edit, by the arrays.

Cases: a null text is as an empty one; two empty texts have likeness 1, an empty and another 0. Texts of any length
are hashed whole. Repeated ids are told apart by their text; null ids sort before the others. A table of
one row is its own next document. An empty table gives an empty result. Columns beside the named ones are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
MARKS = 32
#: Rows of a shard of the ordered documents, about.
SHARD_ROWS = 4_000
_powers: list[np.ndarray] = []


def _power(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length())
        _powers.clear()
        for p, b in [*zip(PRIMES, BASES, strict=True), *((p, pow(b, -1, p)) for p, b in zip(PRIMES, BASES, strict=True))]:
            out = np.ones(size, dtype=np.uint64)
            have, step = 1, b
            while have < size:  # doubling: the next block is the one before times base^have
                out[have : 2 * have] = out[:have] * np.uint64(step) % np.uint64(p)
                have, step = 2 * have, step * step % p
            _powers.append(out)
    return _powers[which + 2 * inverse][:n]


class PrefixHashes:
    """Span equality and longest common extensions of one text."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n = n = len(self.points)
        self.prefix = []
        for which, p in enumerate(PRIMES):
            out = np.zeros(n + 1, dtype=np.uint64)
            terms = (self.points.astype(np.uint64) + np.uint64(1)) * _power(which, n) % np.uint64(p)
            np.cumsum(terms, out=out[1:])  # below 2^31 each, so no overflow up to 2^33 code points
            self.prefix.append(out % np.uint64(p))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end): equal for equal spans wherever they start."""
        out = np.zeros(len(start), dtype=np.uint64)
        for which, p in enumerate(PRIMES):
            shift = _power(which, self.n + 1, inverse=True)[start]
            value = (self.prefix[which][end] + np.uint64(p) - self.prefix[which][start]) % np.uint64(p) * shift % np.uint64(p)
            out = out << np.uint64(31) | value
        return out

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        if i + length > self.n or j + length > other.n:
            return False
        at = lambda x: np.array([x])
        return bool(self.spans(at(i), at(i + length))[0] == other.spans(at(j), at(j + length))[0])

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension from i here and from j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, other: PrefixHashes) -> int:
        """Length of the longest common ending of both texts."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(self.n - mid, other, other.n - mid, mid) else (low, mid - 1)
        return low

    def fingerprint(self) -> str:
        """Length, whole hash, then the hashes of prefixes and of suffixes at multiples of the step; in hexadecimal."""
        step = step_of(self.n)
        ends = np.arange(step, self.n + 1, step)
        zero = np.zeros(len(ends), dtype=np.int64)
        whole = self.spans(np.array([0]), np.array([self.n]))[0]
        marks = np.concatenate([self.spans(zero, ends), self.spans(self.n - ends, zero + self.n)]) % np.uint64(1 << 32)
        return f"{self.n:08x}{int(whole):016x}" + "".join(f"{int(x):08x}" for x in marks)


def step_of(n: int) -> int:
    return 1 << max(0, -(-n // MARKS) - 1).bit_length()


def likeness(a: str, b: str) -> float:
    """Share of the longer text that common prefix and suffix cover, from two fingerprints."""
    if a == b:
        return 1.0
    n, m = int(a[:8], 16), int(b[:8], 16)
    if not n or not m:
        return 0.0
    s, t = step_of(n), step_of(m)
    step = max(s, t)
    common = min(n, m) // step

    def longest(a_from: int, b_from: int) -> int:
        low, high = 0, common
        while low < high:  # equal prefixes of some length have equal shorter ones
            mid = (low + high + 1) // 2
            i, j = a_from + (mid * step // s - 1) * 8, b_from + (mid * step // t - 1) * 8
            low, high = (mid, high) if a[i : i + 8] == b[j : j + 8] else (low, mid - 1)
        return low * step

    both = longest(24, 24) + longest(24 + n // s * 8, 24 + m // t * 8)
    return min(1.0, both / max(n, m))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_prefix long, edited_suffix long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard in ascending order, each shard after a copy of the row that precedes it (own false)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    text, mark = "", PrefixHashes("").fingerprint()
    for batch in batches:
        rows = []
        for doc_id, own, this in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = PrefixHashes(this)
            fingerprint = hashes.fingerprint()
            if own:
                cut = hashes.n // 3
                edited = this[: hashes.n - cut] + text[:cut]
                other = PrefixHashes(edited)
                prefix = hashes.extension(0, other, 0)
                print_ = other.fingerprint()
                rows.append((doc_id, hashes.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint, print_, likeness(fingerprint, print_), likeness(fingerprint, mark), prefix, hashes.extension_back(other)))
            text, mark = this, fingerprint
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document with its fingerprint, that of its edited text, and likenesses.

    The next document of a row, descending by id, is the row before it in ascending order. Shards of that
    order hold about SHARD_ROWS rows; the last row of each goes to the next shard as well, and that of the last to the first.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    n = docs.count()
    shards = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SHARD_ROWS))
    bounds = docs.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if n and shards > 1 else []
    bounds = sorted({int(b) for b in bounds})
    # a shard: how many bounds lie below; equal ids, and so their order, stay in one shard
    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), ids.to_numpy(), side="left").astype(np.int32))

    number = shard(F.coalesce("doc_id", F.lit(-(1 << 63)))) if bounds else F.lit(0)
    docs = docs.withColumns({"shard": number, "tie": F.xxhash64("text")})
    last = docs.groupBy("shard").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "tie")).alias("x")).select("shard", "x.doc_id", "x.tie").collect()  # a row for each shard
    if not last:
        return spark.createDataFrame([], SCHEMA)
    last.sort(key=lambda r: r["shard"])
    follow = {r["shard"]: last[(i + 1) % len(last)]["shard"] for i, r in enumerate(last)}
    edges = spark.createDataFrame([(r["shard"], r["doc_id"], r["tie"], follow[r["shard"]]) for r in last], "shard int, doc_id long, tie long, follow int")
    same = (docs["shard"] == edges["shard"]) & docs["doc_id"].eqNullSafe(edges["doc_id"]) & (docs["tie"] == edges["tie"])
    lasts = docs.join(F.broadcast(edges), same).select(edges["follow"].alias("shard"), docs["doc_id"], "text", docs["tie"]).dropDuplicates(["shard"])
    rows = docs.withColumn("own", F.lit(True)).unionByName(lasts.withColumn("own", F.lit(False)))
    dealt = rows.repartitionByRange(len(last), "shard").sortWithinPartitions("shard", "own", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("doc_id", "own", "text").mapInArrow(_pairs, SCHEMA)
