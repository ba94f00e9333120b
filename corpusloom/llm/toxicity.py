"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that look disguised (look-alike digits or signs
between letters, letters three times or more in a row, single letters spaced or dotted apart, masked letters) are
decoded: a Viterbi search over the lattice of the letters that each sign may stand for, be it an
inserted separator or a repetition, finds the likeliest word under the model. Where there are separators, a second search lets each
be the end of a word too; in what is spelled letter by letter, the words of the features are also looked for at any place. The restored words of a bounded sample of
labelled documents give the features that tell label 1 best by log-likelihood ratio, each a word or a
stem that makes up a part of all words, and a logistic regression over them scores the restored text.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are never read. The inputs of a score
are a text's own words alone.

Cases: null and empty texts have no words and score as such. Without labels of both kinds every score is the
share of label 1 (0 without labels). Several labels of an id: the largest counts. Repeated rows get equal scores. Empty tables
give an empty result. Very long texts are decoded token by token, whole. Columns beside the named ones are dropped by toxicity, kept by drop_toxic,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, text_bytes

# The letters that a digit or sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_ "
ANY = "*#"
_SEPARATED = re.compile(rb"[._ -]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The classifier is fitted on the labelled rows with the smallest hashes of their ids, so many at most.
MOST_LABELLED = 20_000
#: A stem is a word's start of so many bytes; it counts where at least 1 / STEM_RATE of the words have it.
STEMS = (4, 5, 6, 7, 8)
STEM_RATE = 100
RIDGE = 0.3
THRESHOLD = 0.7
#: Feature words of so many bytes at least are looked for inside runs that are spelled letter by letter.
LEAST_FOUND = 4
#: Longer tokens are decoded each time; shorter ones are remembered.
KNOWN_BYTES = 100
_REPEAT, _SIGN, _SKIP, _SEPARATOR, _BOUNDARY = math.log(0.2), math.log(0.3), math.log(1e-5), math.log(0.5), math.log(0.1)
_SYMBOLS = 28  # boundary, 26 letters, all else
_CLASS = bytes(b - 96 if 97 <= b < 123 else b - 64 if 65 <= b < 91 else 27 if b >= 128 else 0 for b in range(256))
_PLAIN = bytes(b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_TRIPLE = re.compile(rb"([a-z])\1\1")
_MIXED = re.compile(rb"[a-z][^a-z\x80-\xff]+[a-z]|^[0-9@$!|+(]+[a-z]|[a-z][0-9@$|+]+$")
_EDGE = b".,;:?\"')]}>%&^~`=/\\<[{#*"


class Restorer:
    """Decodes disguised tokens under a trigram table of log probabilities."""

    def __init__(self, table: np.ndarray):
        self.table = table.tolist()
        self.cube = table.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
        self.known: dict[tuple[bytes, bool], bytes] = {}

    def _score(self, a: int, b: int, c: int) -> float:
        return self.table[(a * _SYMBOLS + b) * _SYMBOLS + c]

    def decode(self, token: bytes, apart: bool = False) -> bytes:
        """The likeliest word; if apart, the likeliest words with blanks between, which may part at separators."""
        found = self.known.get((token, apart))
        if found is None:
            found = self._viterbi(token.decode("latin-1"), apart)
            if len(token) <= KNOWN_BYTES:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[token, apart] = found
        return found

    def restored(self, token: bytes, lexicon: list[bytes]) -> list[bytes]:
        """The token as one word; then the words that separators part it into, and those of the lexicon in it where it is spelled letter by letter."""
        out = [self.decode(token)]
        pieces = _SEPARATED.split(token)
        if len(pieces) > 1:
            parts = self.decode(token, True).split()
            out += parts if len(parts) > 1 else []
            if max(map(len, pieces)) == 1:
                out += [w for w in lexicon if w in out[0] and w not in out]
        return out

    def _viterbi(self, token: str, apart: bool) -> bytes:
        """Best path; a state is the last two symbols, and holds its log probability and its letters so far, last first, as a chain."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, sign in enumerate(token):
            if sign in LETTERS or ord(sign) >= 128:
                options = [(sign, 0.0)]
                silent = _REPEAT if i and token[i - 1] == sign else None
            elif sign in ANY:
                options = []
                silent = _SKIP
            else:
                looks = LOOKS.get(sign, "")
                options = [(c, _SIGN - math.log(len(looks))) for c in looks]
                silent = _SEPARATOR if sign in SEPARATORS else _SKIP if options else _SEPARATOR
                if i and token[i - 1] == sign:
                    silent = max(silent, _REPEAT)
            after = self._any(states) if sign in ANY else {}
            parts = apart and sign in SEPARATORS
            for (a, b), (p, letters) in states.items():
                for letter, cost in options:
                    c = ord(letter) - 96 if letter in LETTERS else 27
                    q = p + cost + self._score(a, b, c)
                    if (b, c) not in after or q > after[b, c][0]:
                        after[b, c] = (q, (letters, letter))
                if parts and b:
                    q = p + _BOUNDARY + self._score(a, b, 0)
                    if (b, 0) not in after or q > after[b, 0][0]:
                        after[b, 0] = (q, (letters, " "))
                if silent is not None:
                    q = p + silent
                    if (a, b) not in after or q > after[a, b][0]:
                        after[a, b] = (q, letters)
            states = after
        chain = max(((p + self._score(a, b, 0), letters) for (a, b), (p, letters) in states.items()), key=lambda x: x[0])[1]
        out = []
        while chain is not None:
            chain, letter = chain
            out.append(letter)
        return "".join(reversed(out)).encode("latin-1")

    def _any(self, states: dict) -> dict:
        """States after a sign that may stand for any letter."""
        dense = np.full((_SYMBOLS, _SYMBOLS), -np.inf)
        for at, (p, _) in states.items():
            dense[at] = p
        scores = dense[:, :, None] + (_SIGN - math.log(26)) + self.cube[:, :, 1:27]
        best, score = scores.argmax(axis=0), scores.max(axis=0)
        froms = best.tolist()
        return {(b, c + 1): (q, (states[froms[b][c], b][1], LETTERS[c])) for b, row in enumerate(score.tolist()) for c, q in enumerate(row) if q > -math.inf}

    def words(self, text: bytes, lexicon: list[bytes] = []) -> list[bytes]:  # noqa: B006
        """Plain words of a text and the restored forms of disguised ones. lexicon: words that are found in any spelled run of letters."""
        out = text.translate(_PLAIN).split()
        low = text.lower()
        tokens = low.split()
        triple = _TRIPLE.search(low)
        for token in set(tokens):
            if token.isalpha() and not triple:
                continue
            core = token.strip(_EDGE)
            if triple and _TRIPLE.search(core) or not core.isalpha() and _MIXED.search(core.rstrip(b"!")):
                out += self.restored(core.rstrip(b"!") if core.rstrip(b"!") else core, lexicon)
        single = bytes([len(t) == 1 for t in tokens])
        at = single.find(b"\x01\x01\x01\x01")
        while at >= 0:
            end = single.find(b"\x00", at)
            end = len(single) if end < 0 else end
            out += self.restored(b" ".join(tokens[at:end]), lexicon)
            at = single.find(b"\x01\x01\x01\x01", end)
        return out


def trigram_table(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Smoothed log probabilities of a symbol after two others, over the whole of all texts."""
    size = _SYMBOLS**3

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch[0].to_pylist():
                c = np.frombuffer(b"\0\0" + text.translate(_CLASS) + b"\0", dtype=np.uint8).astype(np.int32)
                total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["trigram", "n"])

    rows = docs.select(text_bytes(text_column)).mapInArrow(counted, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()  # size rows at most
    counts = np.full(size, 0.05)
    for r in rows:
        counts[r["trigram"]] += r["n"]
    counts = counts.reshape(-1, _SYMBOLS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel()


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1


def features(words: list[bytes], lengths: tuple[int, ...] = STEMS, among: dict[bytes, int] | None = None) -> set[bytes]:
    """Words (after w) and stems (after p) of a text; those in among only, if given."""
    out = {b"w" + w for w in set(words)} if among is None else {b"w" + w for w in set(words) if b"w" + w in among}
    for length in lengths:
        stems = Counter(b"p" + w[:length] for w in words if len(w) >= length)
        out.update(s for s, n in stems.items() if n * STEM_RATE >= len(words) and (among is None or s in among))
    return out


class Model(NamedTuple):
    table: np.ndarray
    weights: dict[bytes, float]
    odds: float

    def score(self, restorer: Restorer, text: bytes) -> float:
        lengths = tuple({len(f) - 1 for f in self.weights if f[:1] == b"p"})
        lexicon = [f[1:] for f in self.weights if f[:1] == b"w" and len(f) > LEAST_FOUND]
        found = features(restorer.words(text, lexicon), lengths, self.weights)
        x = self.odds + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, x))))


def fit(rows: list[tuple[int, list[int]]], size: int) -> np.ndarray:
    """Ridge logistic regression by Newton's steps; the intercept is last and free. rows: label and its features."""
    x = np.zeros((len(rows), size + 1), dtype=np.float32)
    x[:, size] = 1
    for i, (_, found) in enumerate(rows):
        x[i, found] = 1
    y = np.array([label for label, _ in rows], dtype=float)
    w, ridge = np.zeros(size + 1), np.full(size + 1, RIDGE)
    ridge[size] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.diag(ridge)
        for i in range(0, len(x), 1000):
            part = x[i : i + 1000].astype(float)
            curve += (part * (p * (1 - p))[i : i + 1000, None]).T @ part
        step = np.linalg.solve(curve, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    table = trigram_table(docs, text_column)
    sample = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = sample.select(F.col("doc_id").alias("_labelled"), F.col("toxic").cast("long").alias("_toxic"))
    texts = docs.select(F.col(id_column).alias("_doc"), text_bytes(text_column).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_labelled"))  # sample: MOST_LABELLED rows at most
    # copies of a text would lend their words its label again and again
    texts = texts.groupBy(F.xxhash64("_text").alias("h")).agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(table)
        for batch in batches:
            mine = [sorted(features(restorer.words(text))) for text in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[1], pa.array(mine, pa.list_(pa.binary()))], ["toxic", "found"])

    texts = materialise(texts.select("_text", "_toxic").mapInArrow(found, "toxic long, found array<binary>"), "toxicity")
    total = texts.agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count("*").alias("n")).first()
    p, n = total["pos"], total["n"] - total["pos"]
    if not p or not n:
        return Model(table, {}, 20.0 if p else -20.0)
    counts = texts.select(F.explode("found").alias("f"), "toxic").groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count("*").alias("n")).where("n >= 3")
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    # log-likelihood ratio of a feature against chance, which has to beat the number of features tried
    part = lambda k, of: F.when(k > 0, k * F.log(k * (p + n) / (F.col("n") * of))).otherwise(0.0)
    counts = counts.withColumn("gain", 2 * (part(pos, p) + part(neg, n))).where(pos * n > neg * p)
    bar = 2 * math.log(max(2, counts.count()))
    chosen = [bytes(r["f"]) for r in counts.where(F.col("gain") > bar).orderBy(F.desc("gain"), "f").collect()]  # of MOST_LABELLED texts at most
    number = {f: i for i, f in enumerate(chosen)}
    hits = texts.select("toxic", F.filter("found", lambda f: f.isin(chosen)).alias("found") if chosen else F.array().cast("array<binary>").alias("found"))
    rows = sorted((r["toxic"], sorted(number[bytes(f)] for f in r["found"])) for r in hits.collect())  # MOST_LABELLED rows at most
    w = fit(rows, len(chosen))
    return Model(table, dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def scorer(model: Model):
    """A function of a column of UTF-8 bytes: the probability of label 1."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model.table)
        for some in texts:
            yield pd.Series([model.score(restorer, text) for text in some], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each document. labels: doc_id, toxic."""
    score = scorer(learn(docs, labels, id_column, text_column))
    rows = docs.select(docs[id_column].alias("doc_id"), text_bytes(text_column).alias("text"))
    scored = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    score = scorer(learn(docs, labels, id_column, text_column))
    (name,) = fresh(docs, "toxicity")
    return docs.withColumn(name, score(text_bytes(text_column))).where(F.col(name) < THRESHOLD).select(*docs.columns)
