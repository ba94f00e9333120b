"""Packing token ids into sequences by minimum bin slack.

Each document's ids are cut into full windows and one remainder. How many remainders there are of each
length (fewer numbers than a window has tokens, whatever the corpus) is all that a plan needs: again and again
the longest one left opens a window, a bitset subset-sum over the lengths left finds the multiset that
fills it closest to capacity, and the pattern is repeated as often as its counts allow. Documents
find their place by their rank among equal lengths; ranks come from counts by (length, bucket), so
that a length that many copies share is dealt over all buckets.

Cases: a null text is as an empty one: its only id is the end id. Very long texts become many
full windows. Repeated rows are packed each for itself. An empty table gives no pieces. Input columns
beside the named ones are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_bytes
from .tokens import encoder, gathered

CAPACITY = 2048
END_ID = 1
#: Equal lengths are ranked within buckets of this many.
BUCKETS = 256
_TOKENS = "doc_id long, doc_tokens long, crcs array<long>, ids array<int>"


def fill(counts: dict[int, int], room: int, goals: list[int]) -> dict[int, int]:
    """Lengths with their numbers, of those in counts, whose sum is the first of goals that can be met, else as near room as possible."""
    steps: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        most, take = min(counts[length], room // length), 1
        while most > 0 and not reach >> room & 1:
            take = min(take, most)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            most -= take
            take *= 2
        if reach >> room & 1:
            break
    at = next((g for g in goals if 0 <= g <= room and reach >> g & 1), reach.bit_length() - 1)
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, end rank, copies in a sequence, first sequence, offset), and the number of sequences.

    A sequence is best full; else best at a power of two, which needs no padding.
    """
    left = {k: v for k, v in counts.items() if v}
    ranks = dict.fromkeys(left, 0)
    slots, sequence = [], 0
    powers = [1 << k for k in range(capacity.bit_length() - 1, -1, -1)]
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        used = fill({k: v for k, v in rest.items() if v}, capacity - seed, [p - seed for p in powers])
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            slots.append((length, ranks[length], ranks[length] + n * times, n, sequence, offset))
            ranks[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return slots, sequence


def _windowed(batches: Iterator[pa.RecordBatch], end_id: int, capacity: int, vocabulary: str | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words = encoder(vocabulary)
    for some in gathered(batches, 1):
        flat, until = words.encode_flat(some[1])
        for at in range(0, some.num_rows, 250):
            batch = some.slice(at, 250)
            n, crcs, kept = [], [], []
            ends = until[at : at + 250].tolist()
            for start, end in zip([until[at - 1] if at else 0, *ends], ends, strict=False):
                ids = np.append(flat[start:end], np.uint32(end_id)).astype("<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + capacity].tobytes()) for i in range(0, len(ids), capacity)])
                kept.append(ids.view(np.int32) if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], ["doc_id", "doc_tokens", "crcs", "ids"])
    words.rest()


def tokenised(docs: DataFrame, id_column: str, text_column: str, end_id: int, capacity: int, vocabulary: str | None, with_ids: bool) -> DataFrame:
    """Each document's number of ids and the crc32 of each window of them; the ids too if asked for."""
    return docs.select(docs[id_column].cast("long"), text_bytes(text_column)).mapInArrow(lambda b: _windowed(b, end_id, capacity, vocabulary, with_ids), _TOKENS)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    tokens = materialise(tokenised(docs, id_column, text_column, end_id, capacity, vocabulary, with_ids), "packing")
    tokens = tokens.withColumns({"rest": F.col("doc_tokens") % capacity, "full": F.floor(F.col("doc_tokens") / capacity), "bucket": F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(BUCKETS))})
    if not with_ids:
        tokens = tokens.drop("ids")
    rests = tokens.where("rest > 0").groupBy("rest", "bucket").agg(F.count("*").alias("n"))
    slots, sequences = plan({r["rest"]: r["n"] for r in rests.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, capacity)

    before = rests.withColumn("base", F.sum("n").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("n")).drop("n")
    # whole windows take the sequences after the others, in the order of (bucket, doc_id)
    wholes = tokens.where("full > 0").groupBy("bucket").agg(F.sum("full").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("bucket")) - F.col("n") + sequences).drop("n")

    order = [F.col("doc_id"), F.col("doc_tokens"), F.col("crcs")]
    ranked = tokens.where("rest > 0").join(before, ["rest", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("rest", "bucket").orderBy(*order)) - 1)
    ids = (lambda start, n: [F.slice("ids", (start + 1).cast("int"), n.cast("int")).alias("ids")]) if with_ids else (lambda start, n: [])
    start = F.col("doc_tokens") - F.col("rest")
    last = ranked.select("doc_id", start.alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", "rank", *ids(start, F.col("rest")))
    running = F.sum("full").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    long = tokens.where("full > 0").join(F.broadcast(wholes), "bucket").withColumn("first", F.col("first") + F.coalesce(running, F.lit(0)))  # wholes: BUCKETS rows at most
    long = long.select("*", F.posexplode(F.slice("crcs", 1, F.col("full").cast("int"))).alias("i", "ids_crc32"))
    start = F.col("i").cast("long") * capacity
    pieces = long.select("doc_id", start.alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids(start, F.lit(capacity)))
    return place(last, slots).unionByName(pieces)


def place(ranked: DataFrame, slots: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Gives each remainder its sequence and offset. slots: bounded by the capacity, not by the corpus."""
    schema = [f for f in ranked.schema.fields if f.name != "rank"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, copies, sequence, offset = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6).T
        keys = (length << 44) + first
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (get("length") << 44) + get("rank"), side="right") - 1
            i = get("rank") - first[at]
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence[at] + i // copies[at]), pa.array(offset[at] + i % copies[at] * length[at])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return ranked.mapInArrow(rows, f"{kinds}, sequence_id long, offset long")
