"""Suffix-array dedup, depth-limited: removes every byte that a repeated string of THRESHOLD bytes covers.

Only the order of suffixes down to THRESHOLD bytes matters, and of that only which of them are equal so deep. They
are dealt by most-significant-digit passes: each pass takes further bytes as its digit, carries the number of the group
that the digits so far have made, and lets what is alone in its group go; groups that are left at full depth are the
repeated windows.

An exact filter stands in front, as a row for each suffix would be many times the input. A window's anchor is the position in it
whose SEED bytes have the least hash. Equal windows have theirs at the same offset, so a window repeats only if its anchor's seed does, and
the suffixes to order are those that start up to THRESHOLD - SEED bytes before such an anchor. They go through the
passes as ranges of offsets. All windows of a range share a core of bytes; the first digit is the seed, a pass halves each range,
and its digit is what a half's core has beyond the core of the whole. A core that no other anchor has lets its whole range go. The windows
of a range fill its hull; where another anchor of the same group has the same hull, all of them are repeated and
done, and one anchor for each hull goes on as a partner of the open ones. As in any radix sort, small groups are finished at once:
the bytes around the anchors of a group of up to SMALL hulls are compared pair by pair, which gives the repeated windows
of each. Larger groups are halved again; after eight halvings a range is one window.

Digits of up to 15 bytes are themselves, longer ones their 128-bit BLAKE2b, the root's hulls two 64-bit polynomial hashes. Group numbers
are numbers of anchors and documents are told by a number of their row; hashes of seeds only rule pairs out.

Cases: a null text is as an empty one. Texts below THRESHOLD bytes keep all; repeated rows above it lose all.
Nulls as ids are ids like others. Very long and periodic texts are treated whole, with as many rows as they have anchors (at most one a byte).
An empty table gives an empty result. Columns beside the named ones are dropped by repeats, kept by drop_repeats, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, bucketed, discard, fresh, materialise, mix, powers, prefix_hashes, span_hashes, text_bytes

THRESHOLD = 200
SEED = 32
OFFSETS = THRESHOLD - SEED + 1  # windows that hold an anchor
SMALL = 32
TOGETHER = 1 << 16
_LITERAL = 15
_WIDTH = OFFSETS - 1 + THRESHOLD
_OTHER = (np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64), 0xD1342543DE82EF95)
_KIDS = "gid long, a int, b int, core binary, hull binary, anchor long, id long, pos int, open boolean"


def _sliding(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of width numbers, by doubling."""
    size = 1
    while size * 2 <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of texts that lie one after another and stop at ends, hashes of their seeds, and of their hulls with the place of the anchor therein (two numbers each).

    No window reaches over an end.
    """
    if len(raw) < THRESHOLD:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    prefix = prefix_hashes(raw)
    seeds = mix((prefix[SEED:] - prefix[:-SEED]) * powers(len(raw))[1][: len(raw) - SEED + 1])
    order = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # equal ones are anchors all
    least = _sliding(order, OFFSETS, np.minimum)
    sizes = np.diff(ends, prepend=0)
    inside = np.repeat(ends, sizes)[: len(least)] >= np.arange(THRESHOLD, THRESHOLD + len(least))
    pad = np.zeros(OFFSETS - 1, dtype=np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least * inside, pad]), OFFSETS, np.maximum) == order)
    text = np.searchsorted(ends, at, side="right")
    low, high = np.maximum(at - (OFFSETS - 1), (ends - sizes)[text]), np.minimum(at + THRESHOLD, ends[text])
    place = mix(((at - low) * (THRESHOLD + 1) + high - at).astype(np.uint64) + np.uint64(1))
    other = prefix_hashes(raw, _OTHER[0], _OTHER[1])
    return at, seeds[at], np.stack([mix(span_hashes(prefix, low, high) ^ place), mix(span_hashes(other, low, high, _OTHER[1]) + place)], axis=1)


def digit(raw: bytes) -> bytes:
    """Bytes as one digit: equal for equal bytes only."""
    return raw if len(raw) <= _LITERAL else hashlib.blake2b(raw, digest_size=16).digest()


def hull(text: bytes, pos: int, a: int, b: int) -> bytes:
    """Digit of the bytes that the windows with the anchor at pos at offsets a to b fill beyond their core, cut at the ends of the text."""
    low = pos - b if pos > b else 0
    return digit(bytes((pos - a - low,)) + text[low : pos - a] + text[pos - b + THRESHOLD : pos - a + THRESHOLD])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor, with the digit of its hull. Texts are scanned together, about TOGETHER bytes at a time."""

    def packed(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        at, seeds, hulls = anchors(np.frombuffer(b"".join(texts), dtype=np.uint8), ends)
        text = np.searchsorted(ends, at, side="right")
        inside = at - np.concatenate([[0], ends])[text]
        raw = pa.py_buffer(np.ascontiguousarray(hulls))
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[text]), pa.array(inside.astype(np.int32)), pa.array(as_long(seeds)), pa.Array.from_buffers(pa.binary(16), len(at), [None, raw]).cast(pa.binary())], ["id", "pos", "seed", "hull"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if len(text) >= THRESHOLD:
                ids.append(number)
                texts.append(text)
                size += len(text)
            if size >= TOGETHER:
                yield packed(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts)


def _halved(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """The halves of the ranges listed for a text, those that hold a window inside it, with the digits of their cores and hulls."""
    names = [x.split()[0] for x in _KIDS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows = []
        for number, text, found in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("found"), strict=True):
            n = len(text)
            fields = [found.values.field(c).to_pylist() for c in ("gid", "a", "b", "anchor", "pos", "open")]
            for gid, a, b, anchor, pos, open_ in zip(*fields, strict=True):
                mid = (a + b) // 2
                least, most = pos + THRESHOLD - n, pos  # offsets of windows inside the text
                if a <= most and mid >= least:
                    core = text[pos - a : pos - mid + THRESHOLD] if first else text[pos - b + THRESHOLD : pos - mid + THRESHOLD]
                    rows.append((gid, a, mid, digit(core), hull(text, pos, a, mid), anchor, number, pos, open_))
                if mid < b and mid + 1 <= most and b >= least:
                    core = text[pos - mid - 1 : pos - b + THRESHOLD] if first else text[pos - mid - 1 : pos - a]
                    rows.append((gid, mid + 1, b, digit(core), hull(text, pos, mid + 1, b), anchor, number, pos, open_))
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows of the listed ranges fill."""
    for batch in batches:
        names = ["gid", "a", "b", "pos", "open"]
        for number, text, found in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("found"), strict=True):
            fields = [found.values.field(c) for c in names]
            a, b, pos = (f.to_pylist() for f in fields[1:4])
            lows = [p - y if p > y else 0 for p, y in zip(pos, b, strict=True)]
            parts = [text[low : p - x + THRESHOLD] for low, p, x in zip(lows, pos, a, strict=True)]
            left = [p - low for p, low in zip(pos, lows, strict=True)]
            yield pa.RecordBatch.from_arrays([*fields, pa.array([number] * len(parts), pa.int64()), pa.array(left, pa.int32()), pa.array(parts, pa.binary())], [*names, "id", "left", "bytes"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gid, a), SMALL of a group at most. Each pair of a group is compared byte by byte."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        gid, a = table.column("gid").to_numpy(), table.column("a").to_numpy()
        fresh_ = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (a[1:] != a[:-1])]))
        held = table.slice(fresh_[-1])  # its group may go on
        if fresh_[-1]:
            yield _pairs(table.slice(0, fresh_[-1]), np.diff(fresh_))
    if held is not None:
        yield _pairs(held, np.array([held.num_rows]))


def _pairs(table: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
    get = lambda c: table.column(c).to_numpy().astype(np.int64)
    a, b, pos, left, open_ = get("a"), get("b"), get("pos"), get("left"), table.column("open").to_numpy().astype(bool)
    parts = table.column("bytes").to_pylist()
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    grid = np.zeros((len(parts), _WIDTH), dtype=np.uint8)  # the anchor is at column OFFSETS - 1
    at = np.arange(len(parts)) * _WIDTH + OFFSETS - 1 - left
    grid.reshape(-1)[np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    # each row with those behind it in its group
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    behind = begin + np.repeat(sizes, sizes) - 1 - np.arange(len(parts))
    x = np.repeat(np.arange(len(parts)), behind)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(behind) - behind, behind)
    some = open_[x] | open_[y]
    x, y = x[some], y[some]
    out = []
    for i in range(0, len(x), 20_000):
        p, q = x[i : i + 20_000], y[i : i + 20_000]
        differ = np.ones((len(p), _WIDTH + 2), dtype=bool)  # with an end on either side
        differ[:, 1:-1] = grid[p] != grid[q]
        right = np.minimum(differ[:, OFFSETS:].argmax(axis=1), np.minimum(size[p] - left[p], size[q] - left[q]))
        lefts = np.minimum(differ[:, OFFSETS - 1 :: -1].argmax(axis=1), np.minimum(left[p], left[q]))
        least, most = np.maximum(a[p], THRESHOLD - right), np.minimum(b[p], lefts)
        for row in (p, q):
            ok = (least <= most) & open_[row]
            out.append(np.stack([row[ok], most[ok], least[ok]], axis=1))
    found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)
    row = found[:, 0]
    return pa.RecordBatch.from_arrays([pa.array(get("id")[row]), pa.array((pos[row] - found[:, 1]).astype(np.int32)), pa.array((pos[row] - found[:, 2] + THRESHOLD).astype(np.int32))], ["id", "low", "high"])


def _pass(kids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: intervals (id, low, high) that are known to be repeated now; ranges that go on, with their groups' numbers and numbers of hulls.

    Rows of a group are counted before they are shuffled; the joins meet a group's rows with one row for the group, which
    lets Spark split a large group over tasks.
    """
    key = ["gid", "a", "core"]
    hulls = kids.groupBy(*key, "b", "hull").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("anchor", "id", "pos")), F.max(F.col("open").cast("int")).alias("open"))
    hulls = materialise(hulls, "hulls")
    again = hulls.where("n > 1 AND open = 1").select(*key, "hull")
    done = kids.where("open").join(again, [*key, "hull"], "left_semi").select("id", (F.col("pos") - F.col("b")).alias("low"), (F.col("pos") - F.col("a") + THRESHOLD).alias("high"))
    done = materialise(done, "runs")
    left = (F.col("open") == 1) & (F.col("n") == 1)
    groups = hulls.groupBy(*key).agg(F.min("anchor").alias("group"), F.count("*").alias("k"), F.max(left.cast("int")).alias("left")).where("k > 1 AND left = 1").select(*key, "group", "k")
    groups = materialise(groups, "groups")
    state = materialise(hulls.join(groups, key).select(F.col("group").alias("gid"), "a", "b", "anchor", "id", "pos", left.alias("open"), "k"), "ranges")
    discard(hulls, kids, groups)
    return done, state


def repeated_runs(texts: DataFrame) -> DataFrame:
    """id, runs (low, high) of the texts (id, text as bytes) with repeated windows; ids are unique, texts is bucketed by id."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = materialise(texts.select("id", "text").mapInArrow(_scanned, "id long, pos int, seed long, hull binary"), "anchors")
    again = materialise(scanned.groupBy("seed").count().where("count > 1").select("seed"), "seeds")  # written first, so that Spark can split a common seed's rows in the join
    common = scanned.join(again, "seed", "left_semi")
    range_ = [F.lit(0).cast("long").alias("gid"), F.lit(0).alias("a"), F.lit(OFFSETS - 1).alias("b")]
    kids = materialise(common.select(*range_, F.col("seed").cast("string").cast("binary").alias("core"), "hull", F.monotonically_increasing_id().alias("anchor"), "id", "pos", F.lit(True).alias("open")), "ranges")
    discard(scanned, again)
    found, states, first, width = [], [], True, OFFSETS
    listed = lambda rows, *more: rows.groupBy("id").agg(F.collect_list(F.struct("gid", "a", "b", *more, "pos", "open")).alias("found"))  # noqa: E731  # bounded by a document
    while True:
        done, state = _pass(kids)
        found.append(done)
        states.append(state)
        large = state.where(F.col("k") > SMALL)
        if width == 1 or large.isEmpty():
            break
        kids = materialise(texts.select("id", "text").join(listed(large, "anchor"), "id").mapInArrow(lambda x, f=first: _halved(x, f), _KIDS), "halves")
        first, width = False, (width + 1) // 2
    small = reduce(DataFrame.unionByName, states).where(F.col("k") <= SMALL)
    around = texts.select("id", "text").join(listed(small), "id").mapInArrow(_around, "gid long, a int, b int, pos int, open boolean, id long, left int, bytes binary")
    found.append(materialise(around.repartition(n, "gid", "a").sortWithinPartitions("gid", "a").mapInArrow(_compared, "id long, low int, high int"), "runs"))
    discard(*states)
    runs = reduce(DataFrame.unionByName, found)
    return runs.groupBy("id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))  # bounded by a document


def merged(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs of intervals, cut at 0 and n, in rows of two; those that touch are one."""
    if not len(low):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(low, kind="stable")
    low, high = np.maximum(low[order], 0), np.maximum.accumulate(np.minimum(high[order], n))
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return np.stack([low[first], high[np.append(first[1:], len(low)) - 1]], axis=1)


def _kept(text: bytes, cut: np.ndarray) -> bytes:
    at = [0, *cut.ravel().tolist(), len(text)]
    return b"".join(text[at[i] : at[i + 1]] for i in range(0, len(at), 2))


def _numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a number for each row, bucketed by it. The rows are written first, so that a lost task can't number them anew."""
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    out = bucketed(rows, "rows", number)
    discard(rows)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, low, high in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("low"), batch.column("high"), strict=True):
            cut = merged(low.values.to_numpy(), high.values.to_numpy(), len(text)) if low.is_valid else np.zeros((0, 2), dtype=np.int64)
            kept = _kept(text, cut)
            rows.append((doc_id, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    texts = _numbered(docs.select(docs[id_column].cast("long").alias("doc_id"), text_bytes(text_column).alias("text")), "id")
    runs = repeated_runs(texts)
    return texts.join(runs, "id", "left").select("doc_id", "text", "low", "high").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """The rows of docs with their texts cut, without those of which nothing is left; characters that a cut splits go.

    Texts that were empty before stay. length_column, if given, becomes the new length in characters.
    """
    number, starts, ends = fresh(docs, "row_number", "run_starts", "run_ends")
    rows = _numbered(docs, number)
    runs = repeated_runs(rows.select(F.col(number).alias("id"), text_bytes(text_column).alias("text"))).select(F.col("id").alias(number), F.col("low").alias(starts), F.col("high").alias(ends))

    @F.pandas_udf("string")
    def cut(texts, lows, highs):
        import pandas as pd

        none = np.zeros(0, dtype=np.int64)
        rows = ((t, none if x is None else np.asarray(x), none if y is None else np.asarray(y)) for t, x, y in zip(texts, lows, highs, strict=True))
        return pd.Series([_kept(t, merged(x, y, len(t))).decode("utf-8", "ignore") for t, x, y in rows], dtype=object)

    rows = rows.join(runs, number, "left")
    has = F.col(starts).isNotNull()
    rows = rows.withColumn(text_column, F.when(has, cut(text_bytes(text_column), F.col(starts), F.col(ends))).otherwise(F.col(text_column))).where(~has | (F.length(text_column) > 0))
    if length_column:
        rows = rows.withColumn(length_column, F.when(has, F.length(text_column).cast(docs.schema[length_column].dataType)).otherwise(F.col(length_column)))
    return rows.select(*docs.columns)
