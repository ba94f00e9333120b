"""Language-model scores by Katz backoff: Good-Turing discounted counts of words and word pairs, exactly normalised backoff weights.

A text is its lower-cased words and one end; the first word follows a start. The model, recursively:

    p(w | v) = d2(c(vw)) * c(vw) / c(v)     where the pair was seen in training
             = alpha(v) * p(w)              else; alpha(v) = 1 where v never preceded anything
    p(w)     = d1(c(w)) * c(w) / N          where the word was seen
             = what these leave of 1        else: one class of unknown words

d(r) is Good-Turing's (r + 1) n(r + 1) / (r n(r)) for r up to RELIABLE where that lies between 0 and 1, else the same from a line through
log n(r), so every count is discounted, if ever so little, and every history leaves something. alpha(v) is what the pairs of v
leave of 1 over what the words of these pairs leave of 1, so that p( | v) sums to 1.

How it runs. Texts become blocks of about BLOCK_BYTES: numbers of words, written once. A block asks for each of its distinct words and pairs
once, by 64-bit hashes; hash ranges are buckets, a row holds what a block asks of a bucket, packed. Buckets add up
counts (training) or look them up (scoring) and answer by block in the order they were asked, without the keys. A block that is told that it asked first for
a pair adds the pair to the sums of its history, so each distinct pair counts once in alpha. A word or pair that all texts share is one entry of a
block, not one of a text, so no key is hot. Buckets and blocks are bounded: their number grows with the input, not their size. Blocks ask for the pairs of held-out texts along with the others, with a count of 0, so their answers serve scoring too.

Pairs are as long as histories get: of three words nearly every one is new (three quarters of all tokens in the tables given), and weights of their
backoffs would need all of these joined with the pairs, more than the disk that this may take.

Cases: a null or empty text is one end. Without training rows nothing is known: the base is uniform over one class and the model gives probability 1. Null ids train and aren't
held out. Repeated rows count and are scored each. A very long text is one block. An empty table gives an empty result. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialise, mix, prefix_hashes, release, span_hashes, text_bytes

BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 4_000_000
RELIABLE = 7
WORDS_AT_ONCE = 100_000
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# Numbers as bytes: how many bytes the largest takes, then the lowest bytes of all, the next ones and so on.


def planes(x: np.ndarray) -> bytes:
    if not len(x):
        return b""
    low = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    size = max([1, *(i + 1 for i in range(len(low)) if low[i].any())])
    return bytes([size]) + low[:size].tobytes()


def unplaned(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=kind)
    low = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((low.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, : raw[0]] = low.T
    return out.view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw), dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, one after another, and how many each text has."""
    raw = np.frombuffer(b" ".join([*(t.translate(_LOWER) for t in texts), b""]), dtype=np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13))])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    out = [np.zeros(0, dtype=np.uint64)]
    for low in range(0, len(start), WORDS_AT_ONCE):
        a, b = start[low : low + WORDS_AT_ONCE], end[low : low + WORDS_AT_ONCE]
        out.append(span_hashes(prefix_hashes(raw[a[0] : b[-1]]), a - a[0], b - a[0]))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(out), np.diff(np.searchsorted(start, begins))


#: Columns of a block's row that Block takes.
COLUMNS = ("words", "ranks", "tokens", "sizes", "train")


class Block:
    """Texts as numbers of words: words (rising hashes), tokens (places in words, an end behind each text), sizes and train of each text.

    ranks: the places of words by how often they stand in the block; tokens are kept as ranks, of which most are small.
    """

    def __init__(self, words: bytes, ranks: bytes, tokens: bytes, sizes: bytes, train: bytes):
        self.words = unpacked(words)
        self.tokens = unplaned(ranks, np.uint32)[unplaned(tokens, np.uint32)]
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.train = np.frombuffer(train, dtype=np.bool_)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        start = np.searchsorted(self.words, _START).astype(np.uint32)
        self.before = np.concatenate([[start], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.before[np.cumsum(self.sizes)[:-1]] = start

    def pairs(self) -> np.ndarray:
        return mix(mix(self.words * _ODD)[self.before] + self.words[self.tokens])

    def learned(self) -> np.ndarray:
        """How often each word stands in the texts to learn from."""
        return np.bincount(self.tokens[self.train[self.text]], minlength=len(self.words))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (rising keys), a token of each, and how often each stands in the texts to learn from."""
        keys, first, place = np.unique(self.pairs(), return_index=True, return_inverse=True)
        return keys, first, np.bincount(place[self.train[self.text]], minlength=len(keys))


def _block(ids: list, train: list, texts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = np.concatenate([s for _, s in texts]).astype(np.int64) + 1
    tokens = np.empty(int(sizes.sum()), dtype=np.uint64)
    end = np.zeros(len(tokens), dtype=bool)
    end[np.cumsum(sizes) - 1] = True
    tokens[end], tokens[~end] = _END, np.concatenate([h for h, _ in texts])
    words, places, times = np.unique(np.append(tokens, _START), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable").astype(np.uint32)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    row = {"ids": ids, "n": len(tokens), "learned": int(sum(train)), "words": packed(words), "ranks": planes(order), "tokens": planes(rank[places[:-1]]), "sizes": sizes.tobytes(), "train": np.array(train, dtype=np.bool_).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("learned", pa.int64()), *((c, pa.binary()) for c in COLUMNS)]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, train, texts, size = [], [], [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 250):
            part = batch.slice(begin, 250)
            raw = part[2].to_pylist()
            ids += part[0].to_pylist()
            train += part[1].to_pylist()
            texts.append(word_hashes(raw))
            size += sum(map(len, raw))
            if size >= BLOCK_BYTES:
                yield _block(ids, train, texts)
                ids, train, texts, size = [], [], [], 0
    if ids:
        yield _block(ids, train, texts)


def blocks(docs: DataFrame, held_out: F.Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The texts as blocks, written as a table that dropped() deletes."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), (~held_out).alias("train"), text_bytes(text_column).alias("text"))
    schema = "ids array<long>, n long, learned long, words binary, ranks binary, tokens binary, sizes binary, train binary"
    # numbers are fixed once they are written; answers meet them without a shuffle of the blocks
    return bucketed(rows.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id()), "blocks", "block")


def _of_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that rising keys fall in, and which keys these are."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])[: len(keys)])
    for a, b in zip(first, np.append(first[1:], len(keys))):  # without keys there are no firsts
        yield int(which[a]), slice(a, b)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block]]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        yield row, Block(*(row[c] for c in COLUMNS))


def _asks(batches: Iterator[pa.RecordBatch], buckets: int, training: bool, pairs: bool) -> Iterator[pa.RecordBatch]:
    """What each block asks of each bucket: its words of buckets from 0, its pairs of buckets from `buckets`; in training with what it counted of each, 0 for texts that are held out."""
    for batch in batches:
        for row, block in _read(batch):
            asked = [(0, block.words, block.learned() if training else None)]
            if pairs:
                keys, _, times = block.distinct()
                asked.append((buckets, keys, times))
            out = [(shift + b, row["block"], packed(keys[at]), planes(n[at].astype(np.uint32)) if training else None) for shift, keys, n in asked for b, at in _of_bucket(keys, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "counts"])


def _asked(rows: DataFrame, buckets: int, training: bool, pairs: bool = True) -> DataFrame:
    return rows.select("block", *COLUMNS).mapInArrow(lambda b: _asks(b, buckets, training, pairs), "bucket int, block long, keys binary, counts binary")


_TALLY = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("facts", pa.list_(pa.int64()))])


def _tally(table: pa.Table) -> pa.Table:
    """Of one bucket: its keys with their counts (none of 0), and for each block the counts in the order asked, doubled, odd where it was the first to ask.

    facts: how many keys have a count of 1, 2, ... RELIABLE + 1; how many there are; the sum of counts.
    """
    table = table.sort_by("block")
    bucket, asked = table["bucket"][0].as_py(), [unpacked(k) for k in table["keys"].to_pylist()]
    keys = np.concatenate(asked)
    counts = np.concatenate([unplaned(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
    total = np.add.reduceat(counts[order], first)
    answers = np.empty(len(keys), dtype=np.uint64)
    answers[order] = np.repeat(total, np.diff(np.append(first, len(keys)))) << np.uint64(1)
    answers[order[first]] |= np.uint64(1)
    some = total > 0
    facts = [int((total == r).sum()) for r in range(1, RELIABLE + 2)] + [int(some.sum()), int(total.sum())]
    parts = np.split(answers, np.cumsum([len(a) for a in asked])[:-1])
    rows = [{"bucket": bucket, "block": None, "keys": packed(keys[order[first]][some]), "counts": planes(total[some]), "facts": facts}]
    rows += [{"bucket": bucket, "block": b, "counts": planes(p)} for b, p in zip(table["block"].to_pylist(), parts, strict=True)]
    return pa.Table.from_pylist(rows, schema=_TALLY)


class Discount:
    """d(r) of counts, from how many keys have a count of 1, 2, ... RELIABLE + 1."""

    def __init__(self, n: list[int]):
        points = [(np.log(r), np.log(k)) for r, k in enumerate(n, 1) if k > 0]
        slope = np.polyfit(*zip(*points, strict=True), 1)[0] if len(points) > 1 else -2.0
        self.slope = float(slope) if slope < -1.01 else -2.0
        known = [(r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0 for r in range(1, len(n))]
        self.few = np.array([0.0, *(d if 0 < d < 1 else self._line(np.float64(r)) for r, d in enumerate(known, 1))])

    def _line(self, r: np.ndarray) -> np.ndarray:
        return (1 + 1 / r) ** (self.slope + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Of counts; 0 of 0."""
        r = np.maximum(counts, 1).astype(np.float64)
        return np.where(counts < len(self.few), self.few[np.minimum(counts, len(self.few) - 1).astype(np.int64)], self._line(r))


class Model(NamedTuple):
    """tables: bucket, keys, counts, backoffs (log10 alpha of words; null of pairs), words in buckets below `buckets`.

    answers: what the blocks were told in training. tokens, types, texts: of training. unknown: probability of the class of unknown words.
    """

    tables: DataFrame | None
    answers: DataFrame | None
    buckets: int
    tokens: int
    types: int
    texts: int
    unknown: float
    words: Discount
    pairs: Discount

    def word(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words with these counts."""
        return np.where(counts > 0, self.words(counts) * counts / max(1, self.tokens), self.unknown)


def _answered(rows: DataFrame, answers: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocks with their answers in order of buckets."""
    found = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *more, "counts"))).alias("found"))  # what a block asked for
    return rows.join(found, "block")


def _joined(found: list[dict], column: str, kind: type = np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *(unplaned(x[column], kind) for x in found)])


def _histories(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Of the pairs that a block was first to ask for: by history, what their discounts take and the probability of their words."""
    for batch in batches:
        for row, block in _read(batch):
            _, token, _ = block.distinct()
            of_words, of_pairs = (_joined([x for x in row["found"] if (x["bucket"] >= model.buckets) == pairs], "counts") for pairs in (False, True))
            p = model.word(of_words >> np.uint64(1))
            own = (of_pairs & np.uint64(1) == 1) & (of_pairs > 1)  # the first to ask for what was seen
            c, token = of_pairs[own] >> np.uint64(1), token[own]
            history = block.before[token]
            taken = np.bincount(history, weights=(1 - model.pairs(c)) * c, minlength=len(block.words))
            seen = np.bincount(history, weights=p[block.tokens[token]], minlength=len(block.words))
            at = np.flatnonzero(taken)
            keys, taken, seen = block.words[at], taken[at], seen[at]
            out = [(b, row["block"], packed(keys[x]), taken[x].tobytes(), seen[x].tobytes()) for b, x in _of_bucket(keys, model.buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "taken", "seen"])


def _weights(words: pa.Table, parts: pa.Table, texts: int, unknown: float) -> pa.Table:
    """The words of a bucket with their backoffs."""
    known = [(unpacked(k), unplaned(c)) for k, c in zip(words["keys"].to_pylist(), words["counts"].to_pylist(), strict=True)]
    parts = parts.sort_by("block")
    told = [unpacked(k) for k in parts["keys"].to_pylist()]
    every = np.concatenate([np.zeros(0, dtype=np.uint64), *told])
    keys = np.union1d(np.concatenate([np.zeros(0, dtype=np.uint64), *(k for k, _ in known)]), every)
    counts = np.zeros(len(keys), dtype=np.uint64)
    for k, c in known:
        counts[np.searchsorted(keys, k)] = c
    at = np.searchsorted(keys, every)
    total = lambda c: np.bincount(at, weights=np.concatenate([np.zeros(0), *(np.frombuffer(x) for x in parts[c].to_pylist())]), minlength=len(keys))
    taken, seen = total("taken"), total("seen")
    before = np.where(keys == _START, texts, counts).astype(np.float64)
    alpha = np.where(taken > 0, taken / np.maximum(before, 1) / np.maximum(1 - seen, unknown), 1.0)
    bucket = (words if words.num_rows else parts)["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([packed(keys)], pa.binary()), "counts": pa.array([planes(counts)], pa.binary()), "backoffs": pa.array([planes(np.log10(alpha))], pa.binary())})


def _taken(batches: Iterator[pa.RecordBatch], d: Discount) -> Iterator[pa.RecordBatch]:
    """What discounts take of the words of a bucket."""
    for batch in batches:
        taken = [float(((1 - d(c)) * c).sum()) for c in map(unplaned, batch[0].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(taken, pa.float64())], ["taken"])


def fitted(rows: DataFrame) -> Model:
    """The model of the texts to learn from of blocks."""
    spark = rows.sparkSession
    tokens, texts = rows.agg(F.sum("n"), F.sum("learned")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(tokens or 0) // BUCKET_TOKENS))
    tally = _asked(rows, buckets, True).groupBy("bucket").applyInArrow(_tally, "bucket int, block long, keys binary, counts binary, facts array<long>")
    tally = materialise(tally, "tally")
    release(spark)
    tables, answers = tally.where("block is null"), tally.where("block is not null").select("block", "bucket", "counts")
    facts: dict[bool, list[int]] = {False: [0] * (RELIABLE + 3), True: [0] * (RELIABLE + 3)}
    sums = tables.select((F.col("bucket") >= buckets).alias("pairs"), F.posexplode("facts").alias("i", "v")).groupBy("pairs", "i").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # RELIABLE + 3 numbers each
        facts[r["pairs"]][r["i"]] = r["v"]
    d1, d2 = Discount(facts[False][: RELIABLE + 1]), Discount(facts[True][: RELIABLE + 1])
    types, n = facts[False][RELIABLE + 1], facts[False][RELIABLE + 2]
    of_words = tables.where(F.col("bucket") < buckets)
    taken = of_words.select("counts").mapInArrow(lambda b: _taken(b, d1), "taken double").agg(F.sum("taken")).first()[0]
    model = Model(None, None, buckets, n, types, texts or 0, taken / n if n else 1.0, d1, d2)
    found = _answered(rows.select("block", *COLUMNS), answers)
    parts = found.mapInArrow(lambda b: _histories(b, model), "bucket int, block long, keys binary, taken binary, seen binary")
    schema = "bucket int, keys binary, counts binary, backoffs binary"
    unknown = model.unknown
    words = of_words.select("bucket", "keys", "counts").groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(lambda a, b: _weights(a, b, model.texts, unknown), schema)
    words = materialise(words, "words")
    release(spark)
    pairs = tables.where(F.col("bucket") >= buckets).select("bucket", "keys", "counts", F.lit(None).cast("binary").alias("backoffs"))
    return model._replace(tables=words.unionByName(pairs), answers=answers)


def _looked_up(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The counts and backoffs of what blocks asked of a bucket; 0 where it isn't there."""
    keys, counts, backoffs = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), None
    if table.num_rows:
        keys, counts = unpacked(table["keys"][0].as_py()), unplaned(table["counts"][0].as_py())
        weights = table["backoffs"][0].as_py()
        backoffs = None if weights is None else unplaned(weights, np.float64)
    out = []
    for bucket, block, raw in zip(*(asked[c].to_pylist() for c in ("bucket", "block", "keys")), strict=True):
        own = unpacked(raw)
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
        pick = lambda x, hit=hit, at=at: np.where(hit, x[at] if len(x) else 0, 0).astype(x.dtype)
        out.append((block, bucket, planes(pick(counts)), b"" if backoffs is None else planes(pick(backoffs))))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "counts", "backoffs"])


def _scores(batches: Iterator[pa.RecordBatch], model: Model, trained: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, block in _read(batch):
            told = {pairs: [x for x in row["found"] if (x["bucket"] >= model.buckets) == pairs] for pairs in (False, True)}
            c = _joined(told[False], "counts")
            backoff = _joined(told[False], "backoffs", np.float64) if any(x["backoffs"] for x in told[False]) else np.zeros(len(c))
            base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            single = np.log10(model.word(c))
            before = np.where(block.words == _START, model.texts, c)[block.before].astype(np.float64)
            count = _joined(told[True], "counts")
            pair = (count >> np.uint64(1) if trained else count)[np.unique(block.pairs(), return_inverse=True)[1]]
            with np.errstate(divide="ignore"):
                seen = np.log10(model.pairs(pair) * pair / np.maximum(before, 1))
            score = np.where(pair > 0, seen, backoff[block.before] + single[block.tokens])
            total = lambda x, block=block: np.bincount(block.text, weights=x, minlength=len(block.sizes))
            known = total(c[block.tokens] > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(~block.train), pa.array(block.sizes), pa.array(known), pa.array(total(base[block.tokens])), pa.array(total(score))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def scored(rows: DataFrame, model: Model, trained: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of the texts of blocks.

    trained: the blocks are those that the model was made with, which were told the counts of their pairs then.
    """
    spark = rows.sparkSession
    asked = _asked(rows, model.buckets, False, pairs=not trained).select("bucket", "block", "keys")
    tables = model.tables.where(F.col("bucket") < model.buckets) if trained else model.tables
    answers = asked.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_looked_up, "block long, bucket int, counts binary, backoffs binary")
    answers = materialise(answers, "answers")
    release(spark)
    if trained:
        before = model.answers.where(F.col("bucket") >= model.buckets)
        answers = answers.unionByName(before.select("block", "bucket", "counts", F.lit(b"").alias("backoffs")))
    bare = model._replace(tables=None, answers=None)  # as it is sent to tasks
    found = _answered(rows.select("block", "ids", *COLUMNS), answers, ("backoffs",))
    out = found.mapInArrow(lambda b: _scores(b, bare, trained), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def language_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of all documents under the model of those that aren't held out."""
    rows = blocks(docs, held_out(id_column), id_column, text_column)
    return scored(rows, fitted(rows), trained=True)
