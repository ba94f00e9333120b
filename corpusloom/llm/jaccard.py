"""N-gram Jaccard join by universe partition: exact links between shingle sets, and their components.

Two sets of sizes a, b with Jaccard similarity t differ in at most (1 - t) / (1 + t) * (a + b) shingles. In each band of
sizes that bound, H, is one number. Shingles are hashed into segments; a segment matches if both
subsets are equal, or, where it is given a one-deletion neighbourhood, if one deletion makes them so. The
allocation gives k1 segments neighbourhoods (2 units each) and leaves k0 without (1 unit each), with
H + 1 + e units in all; by pigeonhole every linked pair matches somewhere even if up to e units match
trivially, on empty subsets. It takes the k1 and e of least cost per band, signatures written plus the
rows to expect in the buckets of empty subsets. Documents with more than e trivial units write those as well.

Most sets could do with fewer units than their band's: no partner makes their bound as large as H, and fewer than e units are trivial. So a set
and any partner share 1 + spare signatures at least, with spare the units that neither needs. In any order of signatures the last one that two sets share is
among neither's first spare, so each set may leave its first spare out. Half of them go before signatures are dealt, those of the smallest segments, the
others once the sizes of buckets are known, those in the largest. (A set with fewer left out keeps its share in both steps, as both halves grow with spare.) Texts that
have no more than a passage in common mostly share fewer than that. This isn't done where segments have neighbourhoods. Buckets of the same nodes are one.

Hashes of shingles only choose candidates: two shingles with one hash make sets look more alike, never less, so no link is
lost. Links are counted on the words themselves. Texts of equal word sequences, told by a 128-bit BLAKE2b, are one node before that, with a
number of its own.

Candidates share a signature. A bucket's leader is the node that shares most signatures with others; members that sizes and folded parities tell from their leader are no
pair with it, which is seen while the sorted bucket streams by. Pairs are verified in rounds, and nodes that are connected already are no pairs any more: first each
node with the leader that it has in most buckets, then all members of a bucket with its leader, then, in buckets of three or more
that still aren't connected, with 8 more members, 120 more and so on, 16 times as many each round. So no link that could join two components is
lost, while the copies of one text don't meet pair by pair. Texts travel for pairs only that sizes and parities leave. A folded parity of FOLDS longs says nothing of
sets much larger than its bits, so that large texts with a passage in common would all be pairs; members of these buckets carry one of FINE longs as well, if their sets have more than LARGE shingles.

Cases: null texts and texts without words have no shingles and are linked with nothing. Texts shorter than a
shingle are one shingle. Repeated rows and ids get a row each; a component is named by its smallest id, which for rows of
null ids alone is null. Very long texts are sets like others; the search for their allocation doesn't grow with them. An empty table
gives an empty result. Columns beside the named ones are dropped by jaccard_components, kept by drop_near_duplicates, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, discard, fresh, materialise, mix, prefix_hashes, release, span_hashes, text_bytes

WORDS = 4
PERCENT = 85
BAND_RATIO = 1.5
FOLDS = 8  # longs of a folded parity
FINE, LARGE = 64, 768  # longs of a finer one, and the shingles above which a set has one
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    raw = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    hashes = span_hashes(prefix_hashes(raw), start, end)
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total = mix(total * _ODD[0] + hashes[k : k + n])
    return np.unique(total)


def sequence_of(text: bytes) -> bytes | None:
    """A number for a text's sequence of words; null without words."""
    words = text.translate(_LOWER).split()  # of bytes: at ASCII white space
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def linked(a: bytes, b: bytes, words: int, percent: int) -> bool:
    """Whether two texts are linked, counted on their words."""
    x, y = a.translate(_LOWER).split(), b.translate(_LOWER).split()
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in (*x, *y)), dtype=np.int64, count=len(x) + len(y))
    x, y = codes[: len(x)], codes[len(x) :]
    if min(len(x), len(y)) < words:
        # a short text is one shingle, its whole sequence, and no other has so few words in one
        return len(x) == len(y) and bool((x == y).all())
    n, m = len(x) - words + 1, len(y) - words + 1
    total = np.zeros(n + m, dtype=np.int64)
    for k in range(words):  # numbers of pairs (prefix, word), dense anew at each step
        step = np.concatenate([x[k : k + n], y[k : k + m]])
        total = np.unique(total * len(number) + step, return_inverse=True)[1] if k else step
    p, q = np.unique(total[:n]), np.unique(total[n:])
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


@lru_cache
def bands(percent: int, most: int = 1 << 40) -> list[tuple[int, int]]:
    """Smallest and largest size of each band."""
    out, low = [], 1
    while low < most:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high))
        low = high + 1
    return out


def _beyond(mean: float, e: int) -> float:
    """Share of a Poisson distribution beyond e; by its normal approximation where the mean is large."""
    if mean > 50:
        return 0.5 * math.erfc((e + 0.5 - mean) / math.sqrt(2 * mean))
    term, within = math.exp(-mean), 0.0
    for i in range(min(e, 400) + 1):
        within += term
        term *= mean / (i + 1)
    return max(0.0, 1 - within)


@lru_cache
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """(k1, k0, e) of least cost for a band; one segment, the whole set, if linked sets in it must be equal: other sequences of words may have the same set."""
    low, high = bands(percent)[band]
    bound = (100 - percent) * 2 * high // (100 + percent)
    if not bound:
        return 0, 1, 0
    best, n = None, (low + high) / 2
    for k1 in range(min(6, (bound + 2) // 2) + 1):
        units = bound + 1 - 2 * k1
        # the trivial units to expect say where e is worth a trial
        expected = max(0, units) * math.exp(-n / max(1, k1 + max(0, units)))
        trials = {*range(8), *(math.ceil(expected + z * math.sqrt(expected)) for z in range(7))}
        for e in sorted(t for t in trials if t < 8 + bound // 20):
            k0 = max(0, units + e)
            m = k1 + k0
            empty = math.exp(-n / m)
            trivial = k0 * empty + 2 * k1 * empty * (1 + n / m)
            more = _beyond(trivial, e)
            cost = k0 + k1 * (1 + n / m) + 1000 * more
            if best is None or cost < best[0]:
                best = cost, (k1, k0, e)
    return best[1]


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set under the schemes of its band and of all larger ones that a partner may lie in; how many of its band's signatures the set can still spare.

    The lowest byte of a signature is its band.
    """
    n = len(shingles)
    ranges = bands(percent)
    own = next(i for i, (low, high) in enumerate(ranges) if n <= high) if n else 0
    last = own
    while n * 100 >= percent * ranges[last + 1][0]:
        last += 1
    out, spares = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
    for band in range(own, last + 1):
        k1, k0, e = allocation(band, percent)
        m = k1 + k0
        if not n:
            continue
        salt = np.uint64((band + 1) * int(_ODD[2]) % (1 << 64))
        segment = (mix(shingles ^ salt) >> np.uint64(20)) % np.uint64(m)
        value = mix(shingles + salt)
        order = np.argsort(segment.astype(np.uint16) if m <= 1 << 16 else segment, kind="stable")
        segment, value = segment[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, n)).astype(np.uint64)
        total, which = np.add.reduceat(value, first), segment[first]
        sign = lambda s, c, w, salt=salt: mix(mix(s * _ODD[3] + c) + w * _ODD[4] + salt)
        found = [sign(total, size, which)]
        near = which < np.uint64(k1)
        missing = np.setdiff1d(np.arange(m, dtype=np.uint64), which)
        trivial = 2 * int((near & (size < 2)).sum() + (missing < k1).sum()) + int((missing >= k1).sum())
        if k1:
            at = np.repeat(np.arange(len(first)), size.astype(np.int64))
            drop = near[at] & ((size[at] > 1) | (trivial > e))
            found.append(sign((total[at] - value)[drop], (size[at] - np.uint64(1))[drop], which[at][drop]))
        if trivial > e:
            found.append(sign(np.zeros(len(missing), dtype=np.uint64), np.uint64(0), missing))
            size = np.concatenate([size, np.zeros(len(missing), dtype=np.uint64)])
        found, spare = np.concatenate(found) >> np.uint64(8), 0  # 56 bits: equal ones only make candidates
        if k1:
            found = np.unique(found)
        else:
            spare = spare_units(n, m, trivial, band, percent)
            gone = spare // 2
            if gone:
                found = found[np.argpartition(np.minimum(size, np.uint64(255)) << np.uint64(56) | found, gone)[gone:]]
            spare -= gone
        out.append(found << np.uint64(8) | np.uint64(band))
        spares.append(np.full(len(found), spare, dtype=np.int32))
    return np.concatenate(out), np.concatenate(spares)


def spare_units(n: int, units: int, trivial: int, band: int, percent: int) -> int:
    """By how much the units in which a set of n shingles agrees with any partner are more than one, under a scheme without neighbourhoods; trivial ones don't count up to the scheme's e."""
    high = bands(percent)[band][1]
    if units == 1:  # the whole set
        return 0
    bound = (100 - percent) * (n + min(high, n * 100 // percent)) // (100 + percent)
    return units - 1 - bound - min(trivial, allocation(band, percent)[2])


def _keyed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, number of shingles, sequence; the text, packed, where this task meets its sequence first."""
    met: dict[bytes, int] = {}
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        sizes, keys, texts = [], [], []
        for text in batch[1].to_pylist():
            key = sequence_of(text)
            new = key is not None and key not in met
            if new:
                if len(met) > 200_000:
                    met.clear()
                met[key] = len(shingle_set(text, words))
            sizes.append(met[key] if key is not None else 0)
            keys.append(key)
            texts.append(pack.compress(text) if new else None)
        yield pa.RecordBatch.from_arrays([batch[0], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "n_shingles", "key", "text"])


def _signed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A node, its signatures, and how many of a band's it can spare."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for begin in range(0, batch.num_rows, 100):
            part = batch.slice(begin, 100)
            found = [signatures(shingle_set(open_(text), words), percent) for text in part[1].to_pylist()]
            nodes = np.repeat(part[0].to_numpy(), [len(x) for x, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(as_long(np.concatenate([x for x, _ in found]))), pa.array(np.concatenate([x for _, x in found]))], ["node", "signature", "spare"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (signature, node, spare) come sorted by signature. Those of buckets of two or more; one row is held."""
    held, again = None, False  # the last row, and whether the one before is of its bucket
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        signature = table[0].to_numpy()
        same = signature[1:] == signature[:-1]
        keep = np.concatenate([[again], same])
        keep[:-1] |= same
        held, again = table.slice(table.num_rows - 1), bool(keep[-1])
        yield table.slice(0, table.num_rows - 1).filter(pa.array(keep[:-1]))
    if again:
        yield held


def _led(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (signature, node, n, folded) come sorted, a bucket's leader first. Its other members: signature, place (from 1), leader, node, n, folded, and near, whether sizes and folded parities leave a link with the leader.

    Of a bucket only its leader and its size so far are held, however large it is.
    """
    last, head, size = None, (0, 0, np.zeros(FOLDS, dtype=np.int64)), 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        signature, node, n = (batch[i].to_numpy() for i in range(3))
        folds = batch[3].flatten().to_numpy().reshape(rows, FOLDS)
        new = np.concatenate([[signature[0] != last], signature[1:] != signature[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(rows), -1))
        own = at >= 0
        leader, of_n, of_folds = np.where(own, node[at], head[0]), np.where(own, n[at], head[1]), np.where(own[:, None], folds[at], head[2])
        place = np.where(own, np.arange(rows) - at, size + np.arange(rows))
        differ = np.bitwise_count((folds ^ of_folds).view(np.uint64)).sum(axis=1).astype(np.int64)
        near = (n * 100 >= percent * of_n) & (of_n * 100 >= percent * n) & (differ * (100 + percent) <= (100 - percent) * (n + of_n))
        last, head, size = signature[-1], (leader[-1], of_n[-1], of_folds[-1]), int(place[-1]) + 1
        keep = pa.array(place > 0)
        out = [pa.array(x) for x in (signature, place, leader, node, n)]
        yield pa.RecordBatch.from_arrays([*(x.filter(keep) for x in out), batch[3].filter(keep), pa.array(near).filter(keep)], ["signature", "place", "leader", "node", "n", "folded", "near"])


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keep = pa.array([linked(open_(x), open_(y), words, percent) for x, y in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch[0].filter(keep), batch[1].filter(keep)], ["a", "b"])


def parity(shingles: np.ndarray) -> bytes:
    """Bits that say of each of a power of two of buckets whether it holds an odd number of shingles.

    Each shingle that only one of two sets has changes one bit at most, so two sets differ in no fewer shingles than
    their parities in bits.
    """
    size = 1 << max(6, int(2 * len(shingles)).bit_length())
    odd = np.bincount((mix(shingles ^ _ODD[5]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(shingles: np.ndarray, longs: int = FOLDS) -> np.ndarray:
    """The parity of longs * 64 buckets, as that many longs."""
    odd = np.bincount((mix(shingles ^ _ODD[6]) & np.uint64(longs * 64 - 1)).astype(np.int64), minlength=longs * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(percent: int) -> F.Column:
    """Whether sizes and folded parities of a pair leave a link; folded ones differ in no more bits than there are shingles apart."""
    n, m = F.col("n_a"), F.col("n")
    differ = lambda x, y, longs: sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(longs)), F.lit(0))
    few = lambda bits: bits * (100 + percent) <= (100 - percent) * (n + m)
    # the finer ones are null unless both sets are large
    # by array functions: FINE terms would make a method that the JVM doesn't compile
    bits = F.aggregate(F.zip_with("fine_a", "fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fine = F.when(F.col("fine_a").isNull() | F.col("fine").isNull(), True).otherwise(few(bits))
    return (n * 100 >= percent * m) & (m * 100 >= percent * n) & few(differ("folded_a", "folded", FOLDS)) & fine


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities don't rule a link out."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "parity_a", "parity_b")), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
            size = min(len(x), len(y))  # a longer one folds to the shorter: buckets are the low bits of a hash
            differ = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, size), axis=0)).sum()
            keep.append(int(differ) * (100 + percent) <= (100 - percent) * (n + m))
        keep = np.array(keep, dtype=bool)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are linked, counted on their words. Texts travel for pairs only that sizes and parities leave."""
    left = texts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    right = texts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    both = pairs.join(left, "a").join(right, "b").where((F.col("n_a") * 100 >= percent * F.col("n_b")) & (F.col("n_b") * 100 >= percent * F.col("n_a")))
    near = materialise(both.mapInArrow(lambda x: _near(x, percent), "a long, b long"), "near")
    # written, so that Spark knows its size and broadcasts it where it is small
    ids = materialise(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ids")
    some = texts.select("node", "text").join(ids, "node", "left_semi")
    both = near.join(some.select(F.col("node").alias("a"), F.col("text").alias("of_a")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("of_b")), "b")
    links = materialise(both.select("a", "b", "of_a", "of_b").mapInArrow(lambda x: _linked(x, words, percent), "a long, b long"), "links")
    discard(near, ids)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b) that aren't the smallest themselves: large-star and small-star rounds until all are stars: each child has one parent, and no parent is a child."""
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # all edges now point down
        down = materialise(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "components")
        discard(down)
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _labelled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """rows with the component of the column called name, itself where it has none."""
    labels = found.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    return rows.join(labels, name, "left").withColumn(f"of_{name}", F.coalesce(f"of_{name}", name))


def _buckets(groups: DataFrame) -> DataFrame:
    """signature, node, times of the buckets that are left of groups (signature, node, spare): each set leaves those in its largest buckets out that it can spare, and of buckets of the same nodes, of which there are times, one stays."""
    # sizes and nodes' sums are written, so that Spark knows how large they are, and can split a very common signature's rows in the joins
    sizes = materialise(groups.groupBy("signature").agg(F.count("*").alias("size")), "sizes")
    order = Window.partitionBy("node", F.col("signature").bitwiseAND(255)).orderBy(F.desc("size"), "signature")  # a set's signatures in one band
    kept = groups.join(sizes, "signature").withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("spare"))
    kept = materialise(kept.select("signature", "node"), "kept")
    discard(groups, sizes)
    told = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"nodes_{i}") for i in range(2)]  # 128 bits
    sets = kept.groupBy("signature").agg(F.count("*").alias("size"), *told).where("size > 1")
    sets = materialise(sets.groupBy("size", "nodes_0", "nodes_1").agg(F.min("signature").alias("signature"), F.count("*").alias("times")), "sets")
    rows = materialise(kept.join(sets.select("signature", "times"), "signature"), "buckets")
    discard(kept, sets)
    return rows


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, key (of the sequence of words) of each row of docs (doc_id, text); key and component of each sequence."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialise(docs.mapInArrow(lambda x: _keyed(x, words), "doc_id long, n_shingles long, key binary, text binary"), "keyed")
    rows = materialise(keyed.select("doc_id", "n_shingles", "key"), "rows")
    first = keyed.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(first.withColumn("node", F.monotonically_increasing_id()), "texts")  # its numbers are fixed once it is written
    discard(keyed)
    signed = texts.select("node", "text").mapInArrow(lambda x: _signed(x, words, percent), "node long, signature long, spare int").select("signature", "node", "spare")
    groups = signed.repartition(partitions, "signature").sortWithinPartitions("signature").mapInArrow(_groups, "signature long, node long, spare int")
    groups = materialise(groups, "signatures")
    release(spark)
    rows_ = _buckets(groups)
    # a bucket's leader is the node that shares most signatures: of the copies of a text it is the one nearest to all
    weights = materialise(rows_.groupBy("node").agg(F.sum("times").alias("weight")), "weights")
    facts = texts.select("node", "text").join(weights.select("node"), "node", "left_semi").mapInArrow(lambda x: _sets(x, words), "node long, n long, parity binary, folded array<long>, fine array<long>, text binary")
    facts = materialise(facts, "candidates")
    dealt = rows_.select("signature", "node").join(weights, "node").join(facts.select("node", "n", "folded"), "node").repartition(partitions, "signature").sortWithinPartitions("signature", F.desc("weight"), F.desc("node"))
    led = dealt.select("signature", "node", "n", "folded").mapInArrow(lambda x: _led(x, percent), "signature long, place long, leader long, node long, n long, folded array<long>, near boolean")
    led = materialise(led, "led")
    discard(rows_, weights)
    pairs = materialise(led.where("near").groupBy("leader", "node").agg(F.count("*").alias("n")), "pairs")
    best = pairs.groupBy("node").agg(F.max_by("leader", F.struct("n", F.col("leader") * -1)).alias("leader"))
    links = verify(best.select(F.col("leader").alias("a"), F.col("node").alias("b")), facts, words, percent)
    found = components(links)
    # the other pairs with a leader that aren't connected
    rest = _labelled(_labelled(pairs.select("leader", "node"), found, "leader"), found, "node").where("of_leader <> of_node")
    rest = rest.join(best, ["leader", "node"], "left_anti").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    more = verify(rest, facts, words, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    # buckets of three or more: members meet further members than the leader
    some = led.select("signature", "place", "leader", "node", "n", "folded")
    open_ = _labelled(_labelled(some, found, "leader"), found, "node")
    apart = open_.groupBy("signature").agg(F.max("place").alias("most"), F.bool_or(F.col("of_leader") != F.col("of_node")).alias("apart")).where("apart AND most > 1").select("signature")
    fine = facts.where(F.col("fine").isNotNull()).select("node", "fine")
    open_ = materialise(some.drop("leader").join(apart, "signature", "left_semi").join(fine, "node", "left"), "apart")
    discard(led, pairs)
    begin, end = 1, 9
    while True:
        here = _labelled(open_, found, "node")
        led = here.where((F.col("place") >= begin) & (F.col("place") < end)).select("signature", F.col("place").alias("from"), F.col("node").alias("a"), F.col("of_node").alias("of_a"), F.col("n").alias("n_a"), F.col("folded").alias("folded_a"), F.col("fine").alias("fine_a"))
        both = led.join(here, "signature").where((F.col("place") > F.col("from")) & (F.col("of_a") != F.col("of_node")) & _may_link(percent))
        more = materialise(both.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
        if not more.isEmpty():
            new = verify(more, facts, words, percent)
            if not new.isEmpty():
                links = links.unionByName(new)
                found = components(links)
        # buckets go on that have members to lead and two components
        here = _labelled(open_, found, "node")
        still = here.groupBy("signature").agg(F.min("of_node").alias("x"), F.max("of_node").alias("y"), F.max("place").alias("most")).where((F.col("x") < F.col("y")) & (F.col("most") >= end)).select("signature")
        before, open_ = open_, materialise(open_.join(still, "signature", "left_semi"), "apart")
        discard(before, more)
        if open_.isEmpty():
            break
        begin, end = end, 16 * end
    labels = materialise(_labelled(texts.select("key", "node"), found, "node").select("key", F.col("of_node").alias("component")), "labels")
    discard(open_, facts, texts)
    return rows, labels


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rows, found = _grouped(docs.select(docs[id_column].cast("long").alias("doc_id"), text_bytes(text_column).alias("text")), words, percent)
    both = rows.join(found, "key", "left")
    named = both.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named, "names")  # so that Spark can split a large component's rows in the join
    return both.join(named, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sets = [shingle_set(open_(t), words) for t in batch[1].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([folded(s) for s in sets], pa.list_(pa.int64())), pa.array([folded(s, FINE) if len(s) > LARGE else None for s in sets], pa.list_(pa.int64())), batch[1]], ["node", "n", "parity", "folded", "fine", "text"])


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, one of each component (the one of its smallest id; nulls last) and all without words; all columns stay."""
    rows, found = _grouped(docs.select(docs[id_column].cast("long").alias("doc_id"), text_bytes(text_column).alias("text")), words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    key, none, number = fresh(docs, "sequence_key", "id_is_null", "id_or_zero")
    kept = rows.join(found, "key").groupBy("component").agg(F.min(order).alias("x")).select(F.col("x.key").alias(key), F.col("x.none").alias(none), F.col("x.id").alias(number))

    @F.pandas_udf("binary")
    def sequence(texts):
        import pandas as pd

        return pd.Series([sequence_of(t) for t in texts], dtype=object)

    own = docs[id_column].cast("long")
    numbered = docs.withColumns({key: sequence(text_bytes(text_column)), none: own.isNull(), number: F.coalesce(own, F.lit(0))})
    # rows that repeat id and words are one; other rows of the id are none of its business
    one = numbered.where(F.col(key).isNotNull()).join(kept, [key, none, number], "left_semi").dropDuplicates([key, none, number])
    return one.unionByName(numbered.where(F.col(key).isNull())).select(*docs.columns)
