"""Katz scores against a plain model of dictionaries, and that its distributions sum to 1."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import common, katz

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
START, END = object(), object()


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), END]


def discount(counts):
    """d(r), from the counts of all keys."""
    n = collections.Counter(counts)
    points = [(math.log(r), math.log(n[r])) for r in range(1, 9) if n[r]]
    slope = -2.0
    if len(points) > 1:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
        slope = slope if slope < -1.01 else -2.0

    def d(r):
        found = (r + 1) * n[r + 1] / (r * n[r]) if r < 8 and n[r] else 0
        return found if 0 < found < 1 else (1 + 1 / r) ** (slope + 1)

    return d


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.after, self.history = (collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter())
        for text in texts:
            before = START
            for t in tokens(text):
                self.words[t] += 1
                self.pairs[before, t] += 1
                self.after[before].add(t)
                self.history[before] += 1
                before = t
        self.n, self.known = sum(self.words.values()), {}
        self.d1, self.d2 = discount(self.words.values()), discount(self.pairs.values())
        self.unknown = sum((1 - self.d1(c)) * c for c in self.words.values()) / self.n if self.n else 1.0

    def single(self, w):
        return self.d1(self.words[w]) * self.words[w] / self.n if self.words[w] else self.unknown

    def alpha(self, v):
        if v not in self.known:
            self.known[v] = self.alpha_of(v)
        return self.known[v]

    def alpha_of(self, v):
        if not self.history[v]:
            return 1.0
        left = sum((1 - self.d2(self.pairs[v, w])) * self.pairs[v, w] for w in self.after[v]) / self.history[v]
        return left / (1 - sum(self.single(w) for w in self.after[v]))

    def p(self, v, w):
        c = self.pairs[v, w]
        return self.d2(c) * c / self.history[v] if c else self.alpha(v) * self.single(w)

    def scores(self, text):
        mine, before, score, v = tokens(text), START, 0.0, len(self.words)
        for t in mine:
            score += math.log10(self.p(before, t))
            before = t
        base = sum(math.log10((self.words[t] + 0.1) / (self.n + 0.1 * (v + 1))) for t in mine)
        return len(mine), sum(self.words[t] > 0 for t in mine), self.n, base, score


def compare(found, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted([(i, held(i), *model.scores(t)) for i, t in rows], key=repr)
    found = sorted([tuple(r) for r in found.collect()], key=repr)
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=lambda r: (str(r[0]), r[2], round(r[6], 3))), sorted(want, key=lambda r: (str(r[0]), r[2], round(r[6], 3))), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    return model


@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, monkeypatch, small):
    """All documents, repeated rows, nulls, empties, a long text; in one block a task, then in many."""
    common.tune(spark)
    if small:  # more buckets
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 500)
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    rows += [(None, None), (None, "Aa bb\x0bCC"), (1001, ""), (1002, "  \n "), (1003, "é É x" * 2000), (1004, "only these words nowhere else " * 3)] + [(rows[4][0], rows[4][1])] * 3
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, words string").repartition(6)
    found = katz.language_model(docs)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    model = compare(found, rows)
    # p( | v) sums to 1 over all words and the class of unknown ones
    some = [START, *sorted((w for w in model.words if isinstance(w, str)), key=lambda w: -model.words[w])[:3], *sorted(w for w in model.words if isinstance(w, str))[:5], "never seen"]
    for v in some:
        assert math.isclose(sum(model.p(v, w) for w in model.words) + model.p(v, "another word that was never seen"), 1, rel_tol=1e-9)
    # a model scores other texts than its own alike
    if not small:
        rows_of = katz.blocks(docs, katz.held_out())
        compare(katz.scored(katz.blocks(docs.repartition(3), katz.held_out()), katz.fitted(rows_of)), rows)
    held = [r for r in found.collect() if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_odd_tables(spark):
    schema = "doc_id long, text string"
    assert katz.language_model(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = katz.language_model(spark.createDataFrame([(held, "a b"), (held, None)], schema)).collect()
    assert sorted(tuple(r) for r in only) == [(held, True, 1, 0, 0, 0.0, 0.0), (held, True, 3, 0, 0, 0.0, 0.0)]
    rows = [(i, t) for i, t in enumerate(["", None, "a", "a a a", "a b", "b"] * 4)]
    compare(katz.language_model(spark.createDataFrame(rows, schema).repartition(3)), rows)


def test_packing_and_discounts():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (katz.unpacked(katz.packed(keys)) == keys).all() and len(katz.unpacked(katz.packed(keys[:0]))) == 0
    seen = [(b, keys[at]) for b, at in katz._of_bucket(keys, 7)]
    assert [b for b, _ in seen] == list(range(7)) and (np.concatenate([k for _, k in seen]) == keys).all()
    d = katz.Discount([100, 40, 20, 12, 8, 6, 5, 4])
    assert d(np.array([0], dtype=np.uint64))[0] == 0 and math.isclose(d(np.array([1]))[0], 0.8) and ((d(np.arange(1, 2000)) > 0) & (d(np.arange(1, 2000)) < 1)).all()
    assert ((katz.Discount([0] * 8)(np.arange(1, 20)) < 1) & (katz.Discount([0] * 8)(np.arange(1, 20)) > 0)).all()
    texts = [b"", b" a", b"b  c\nd", b"", b"x" * 10]
    hashes, sizes = katz.word_hashes(texts)
    assert sizes.tolist() == [0, 1, 3, 0, 1] and (hashes[0] == katz.word_hashes([b"A"])[0][0])
