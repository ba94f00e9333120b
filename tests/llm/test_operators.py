"""The training-data operators against brute force on small tables with nulls, empties, ties and copies."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import common, fingerprints, jaccard, licenses, mixing, packing, quality, queries, suffix_dedup, token_store, toxicity, warc
from tests.compare import expected, rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Whole texts of the smallest table, edited copies, and the odd cases; two columns whose names operators use."""
    common.tune(spark)
    random.seed(7)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in common.read(spark, SF, "documents").collect()]
    at = 10_000
    for r in rows[:40]:
        words = r[1].split(" ")
        for share in (0.005, 0.02, 0.04):
            copy = [f"zq{random.randrange(10**6)}" if random.random() < share else w for w in words]
            rows.append((at, " ".join(copy), r[2], r[3], 0, None, None))
            at += 1
        cut = random.randrange(max(1, len(r[1]) - 260))
        rows.append((at, "aé" * random.randrange(60) + r[1][cut : cut + random.choice([198, 199, 200, 201, 260])] + "zü" * random.randrange(60), r[2], None, 0, "y", 2))
        at += 1
    rows += [(at, None, None, None, None, None, None), (at + 1, "", "en", "src0", 0, "", 0), (at + 2, "a b", "en", "src1", 3, "", 0), (at + 3, "A  b", "en", None, 4, "", 0), (at + 4, "ab " * 20_000, "en", "src2", 60_000, "", 0)]
    rows += [(at + 5, rows[3][1], "en", "src3", 5, "", 0)] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_license_scan(docs, plain):
    want = collections.Counter()
    for doc_id, text in plain:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[doc_id, len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))] += 1
    found = licenses.license_scan(docs).collect()
    assert collections.Counter(tuple(r[:6]) for r in found) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_license_expressions():
    assert licenses.parse(" MIT OR Apache-2.0 AND GPL-2.0 WITH Classpath-exception".lower()) == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception", "with", "and", "or"]
    assert licenses.parse(" (mit") is None and licenses.parse(" and") is None
    assert licenses.evaluate(licenses.parse("(mit or gpl-2.0) and cc-by-nc-4.0")) == ({"mit", "gpl", "cc-by-nc"}, 0.3)
    assert licenses.evaluate(licenses.parse("mitigated or iscariot")) == ({"unknown"}, 0.5)
    assert licenses.evaluate(licenses.parse("gpl-2.0 with classpath-exception-2.0")) == ({"gpl"}, 0.6) and licenses.evaluate(licenses.parse("gplv2+ with some-exception")) == ({"gpl"}, 0.4)
    assert licenses.evaluate(licenses.parse("bsd-3-clause and lgpl-2.1-or-later")) == ({"bsd", "lgpl"}, 0.6)
    for known in "mit mit-0 apache-2.0 apache2 bsd-3-clause gpl-2.0+ gplv3 gpl-3.0-or-later lgpl-2.1-only cc-by-4.0 cc-by-nc-nd-4.0 zlib artistic-2.0 bsl-1.0 0bsd cc0-1.0 mpl-2.0-no-copyleft-exception cecill-b bzip2-1.0.6 isc".split():
        assert licenses.named(known), known
    for unknown in "mit-nonsense apache-none isc-foo gpl-incompatible mit-1.0 bsd-5-clause gpl-2.0-or-earlier mitx zlib-2.0 cc-by-4.0-xx licenseref-mit apache-2.0-only".split():
        assert licenses.named(unknown) is None, unknown
    row = next(licenses.scan(iter([b"x\n// SPDX-License-Identifier: MIT OR GPL-3.0\nApache   License!"]), licenses._automaton({" apache license ": (" apache license ", "apache", 0.9, True)}), licenses._automaton({t: t for t in licenses.TAGS})))
    assert row[4:6] == ("apache", "apache,gpl,mit")


def _valued(tokens):
    """Labels and openness of an expression by recursive descent: or, then and, then with; None if it doesn't hold together."""

    def unit():
        token = tokens.pop(0)
        if token == "(":
            found = level(0)
            assert tokens.pop(0) == ")"
            return found
        assert token not in ("and", "or", "with", ")")
        name = licenses.named(token)
        return ({licenses.IDENTIFIERS[name][0]}, licenses.IDENTIFIERS[name][1], token) if name else ({"unknown"}, 0.5, token)

    def level(depth):
        operator = ("or", "and", "with")[depth]
        left = level(depth + 1) if depth < 2 else unit()
        while tokens and tokens[0] == operator:
            tokens.pop(0)
            right = level(depth + 1) if depth < 2 else unit()
            if operator == "with":
                loosened = any(re.fullmatch(re.escape(e) + r"([-.]?v?\d+(\.\d+){0,3})?", right[2]) for e in licenses.EXCEPTIONS)
                left = (left[0], max(left[1], 0.6) if loosened else left[1], "")
            else:
                left = (left[0] | right[0], (max if operator == "or" else min)(left[1], right[1]), "")
        return left

    return level(0)[:2]


def test_license_labels_and_scores(spark):
    """Labels, score and openness against a plain reading of every text."""
    said = ["mit", "apache-2.0 or mit", "gpl-2.0 with classpath-exception-2.0 and (bsd-3-clause or mit-nonsense)", "(mit", "", "lgpl-2.1+ and cc-by-4.0"]
    random.seed(5)
    notices = [*licenses.NOTICES, *licenses.BASE, "nothing of this kind"]
    texts = []
    for i in range(60):
        lines = [" ".join(random.choice(notices).title() if random.random() < 0.5 else random.choice(notices) for _ in range(random.randrange(4))) for _ in range(3)]
        lines.insert(random.randrange(3), f"# {random.choice(['SPDX-License-Identifier:', 'License-Expression:', 'other:'])} {said[i % 6]}")
        texts.append((i, "\n".join(lines)))
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    weights = {k: w for k, (_, w) in licenses.NOTICES.items()} | dict.fromkeys(licenses.BASE, licenses.BASE_WEIGHT)
    labels_of = {k: v for k, (v, _) in licenses.NOTICES.items()} | licenses.BASE
    for i, text in texts:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        there = [k for k in weights if any(words[j : j + len(k.split())] == k.split() for j in range(len(words)))]
        labels, rest, open_ = {labels_of[k] for k in there}, 1.0, None
        for k in there:
            rest *= 1 - weights[k]
        for tag in licenses.TAGS:
            at = text.lower().find(tag)
            if at >= 0:
                tokens = re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", text.lower()[at + len(tag) :].split("\n")[0])
                try:
                    value = _valued(tokens)
                    rest *= 1 - licenses.TAG_WEIGHT
                    labels |= value[0]
                    open_ = value[1]
                except (AssertionError, IndexError):
                    rest *= 1 - licenses.BROKEN_TAG_WEIGHT
        assert found[i].labels == ",".join(sorted(labels)) and abs(found[i].score - (1 - rest)) < 1e-12 and found[i].openness == open_, text


def test_quality(docs, plain, spark):
    want = collections.Counter()
    for doc_id, text in plain:
        words = WORD.findall(text)
        places = collections.defaultdict(list)
        for i in range(len(words) - 2):
            places[tuple(words[i : i + 3])].append(i)
        repeated = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)] += 1
    trusted = common.read(spark, SF, "labels").where("quality = 1").select("doc_id")
    found = quality.quality(docs, trusted).collect()
    assert collections.Counter(tuple(r[:7]) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    by_text = collections.defaultdict(set)
    texts = dict(plain)
    for r in found:
        by_text[texts[r.doc_id]].add(r.kept)
    assert all(len(v) == 1 for v in by_text.values())
    none = quality.quality(docs, trusted.where("false")).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_suffix_dedup(docs, plain):
    size, count = suffix_dedup.THRESHOLD, collections.Counter()
    raw = [(i, t.encode()) for i, t in plain]
    for _, t in raw:
        count.update(t[j : j + size] for j in range(len(t) - size + 1))
    want = collections.Counter()
    for doc_id, t in raw:
        covered = np.zeros(len(t) + 1, dtype=int)
        for j in range(len(t) - size + 1):
            if count[t[j : j + size]] > 1:
                covered[j] += 1
                covered[j + size] -= 1
        gone = np.cumsum(covered)[:-1] > 0 if len(t) else np.zeros(0, bool)
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        want[doc_id, len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in suffix_dedup.repeats(docs).collect()) == want


def test_suffix_dedup_cut_partners(spark):
    """Two contents at a text's end are done and differ in a byte; an open text repeats a window of one only."""
    random.seed(3)
    text = lambda n: "".join(random.choices("abcdefghij", k=n))
    rows, want = [], {}
    for i in range(0, 80, 10):
        a = text(205)
        b = "z" + a[1:]
        rows += [(i, a), (i + 1, a), (i + 2, b), (i + 3, b), (i + 4, b[:200] + "x" + text(99)), (i + 5, a[:200] + "y" + text(99)), (i + 6, text(89) + "x" + a[5:])]
        want |= {i + j: 205 if j < 4 else 200 for j in range(7)}
    found = {r.doc_id: r.n_removed for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def _ids(plain, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, tokenizer.encode(t, add_special_tokens=False).ids + [end]) for i, t in plain]


def test_packing(docs, plain):
    pieces = packing.pack(docs, with_ids=True).collect()
    sequences, whole = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        whole[p.doc_id, p.doc_tokens].append((p.start, p.ids))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 2 * 2048
    want = collections.Counter(i for d, ids in _ids(plain, 1) for i in ids)
    assert collections.Counter(i for p in pieces for i in p.ids) == want
    for d, ids in _ids(plain, 1):
        assert any(ids[: len(x)] == x for s, x in whole[d, len(ids)] if s == 0)


def test_packing_plan():
    random.seed(1)
    for _ in range(30):
        counts = {random.randrange(1, 64): random.randrange(1, 30) for _ in range(12)}
        slots, n = packing.plan(counts, 64)
        load = collections.Counter()
        for length, first, end, copies, sequence, _ in slots:
            for i in range((end - first) // copies):
                load[sequence + i] += copies * length
        assert sum(load.values()) == sum(k * v for k, v in counts.items()) and max(load.values()) <= 64 and len(load) == n
    assert packing.plan({}) == ([], 0)


def test_token_store(docs, plain, spark):
    path = common.scratch(spark, "test-store")
    token_store.write_store(docs, path)
    found = sorted(tuple(r) for r in token_store.read_store(spark, path).collect())
    ids = _ids(plain, 2)
    want = [(d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in ids]
    assert sorted((r[0], *r[2:]) for r in found) == sorted(want)
    at = 0
    for r in sorted(found, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in sorted(found, key=lambda r: r[1])] == sorted(d for d, _ in ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    back = collections.Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, path).collect())
    assert back == collections.Counter((d, tuple(x)) for d, x in ids)
    # a changed byte, a lost chunk, a changed recipe, a changed manifest
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    one = chunks.orderBy("address").first()["address"]
    longest = recipes.orderBy(F.size("addresses").desc()).first()["start"]
    for changed, table in (
        (chunks.withColumn("blob", F.when(F.col("address") == F.lit(bytes(one)), F.concat("blob", F.lit(b"\0\0"))).otherwise(F.col("blob"))), "chunks"),
        (chunks.where(F.col("address") != F.lit(bytes(one))), "chunks"),
        (recipes.withColumn("addresses", F.when(F.col("start") == longest, F.reverse("addresses")).otherwise(F.col("addresses"))), "recipes"),
        (manifest.withColumn("root", F.lit(bytes(one))), "manifest"),
    ):
        other = common.scratch(spark, "test-changed")
        for name, df in (("chunks", chunks), ("recipes", recipes), ("manifest", manifest)):
            (changed if name == table else df).write.parquet(f"{other}/{name}")
        with pytest.raises(Exception, match="changed|missing"):
            token_store.read_store(spark, other).collect()


def test_merkle_grows():
    """The growing tree has the root of the plain one, level by level."""
    for n in range(20):
        leaves = [bytes([i]) for i in range(n)]
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert token_store.merkle(leaves) == level[0]


def test_word_encoder():
    """Ids of odd words are the library's."""
    import public_tokenizers
    from corpusloom.llm import tokens
    from tokenizers import Tokenizer

    random.seed(5)
    signs = "abzAZéÉñßÿÀ0179.,;:!?|%&$#*'-_ \t\n\u0130\u0301\u03a3\u4e2d\ud55c\u00b5\u00aa\u200b\xa0<|>"
    texts = ["".join(random.choices(signs, k=random.randrange(1, 30))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = tokens.encoder().encode([t.encode() for t in texts])
    assert [x.tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError, match="word by word"):
        tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_encoder_specials_and_rest():
    """A special token is told by its case; a worker keeps few pieces after a task."""
    import pyarrow as pa
    import public_tokenizers
    from corpusloom.llm import token_store, tokens
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|ENDOFTEXT|> B", "x<|endoftext|>y É", "", " \n", "<|", "it's 12,5 'Re", "word" * 200]
    assert [x.tolist() for x in tokens.encoder().encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    words = ("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words).encode()])], ["doc_id", "text"])
    for task in (token_store._staged(iter([batch]), 2, None), packing._windowed(iter([batch]), 1, 2048, None, False)):
        assert sum(b.num_rows for b in task) == 1
        assert len(tokens.encoder().known) <= tokens.MOST_IDLE


def test_fingerprints(docs, plain):
    order = sorted(plain, key=lambda x: x[0])
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    seen = collections.Counter(d for d, _ in plain)
    for i, (d, text) in enumerate(order):
        if seen[d] > 1 or seen[order[i - 1][0]] > 1:
            continue
        cut = len(text) // 3
        edited = text[: len(text) - cut] + order[i - 1][1][:cut]
        assert (found[d].n_chars, found[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert found[d].fingerprint == fingerprints.PrefixHashes(text).fingerprint() and 0 <= found[d].near_next <= 1
    a, b = fingerprints.PrefixHashes("xxabcdefyy"), fingerprints.PrefixHashes("abcdefz")
    assert a.extension(2, b, 0) == 6 and a.equal(2, b, 0, 6) and not a.equal(1, b, 0, 3)


def test_warc(spark):
    rows = [(i, f"http://x/{i}", h, "e") for i, h in enumerate(["<p>a</p>", None, "", "é" * 30_000, "<p>a</p>", "WARC/1.1\r\n\r\n" * 900, "b"])] + [(9, None, "b", "e")]
    found = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string, kind string")).collect()}
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(i, best.get(h or "", -1))
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        assert found[i].digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and found[i].length == len(raw)
        assert (found[i].kind, found[i].refers_to) == (("response", None) if best[h or ""] == i else ("revisit", best[h or ""]))
        assert best[h or ""] != i or bytes(found[i].payload) == raw


def test_warc_references(spark, tmp_path):
    """Every WARC-Refers-To names a response in the archives, however the rows are spread; record ids are unique, repeated rows included."""
    rows = [(i, f"http://x/{i}", f"payload {i % 20} " * 900) for i in range(400)] + [(399, "http://x/399", f"payload {399 % 20} " * 900), (500, "u", "z"), (500, "u", "z"), (7, "v", "z"), (None, None, "n"), (None, None, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = warc.archive_and_read(pages, str(tmp_path / "a"))
    heads = [h for f in (tmp_path / "a").glob("*.gz") for h, _ in warc._parsed(__import__("gzip").decompress(f.read_bytes()))]
    ids = collections.Counter(h["WARC-Record-ID"] for h in heads)
    assert max(ids.values()) == 1
    responses = {h["WARC-Record-ID"]: h["X-Page-ID"] for h in heads if h["WARC-Type"] == "response" and "X-Page-ID" in h}
    named = [h for h in heads if "WARC-Refers-To" in h]
    assert len(named) == 361 and all(responses[h["WARC-Refers-To"]] == h["X-Refers-To-Page-ID"] for h in named)
    assert sum(h["WARC-Type"] == "revisit" for h in heads) == len(named) + 19 + 1  # those of 399 and 500, which are there twice
    got = found.collect()
    assert len(got) == len(rows) and all(r.refers_to == 380 + r.page_id % 20 for r in got if r.kind == "revisit" and r.page_id < 400 and r.digest not in {x.digest for x in got if x.page_id == 500})


def test_mixing(docs, plain):
    found = mixing.mix_plan(docs).collect()
    assert sorted(tuple(r) for r in mixing.mix_plan(docs.repartition(3)).collect()) == sorted(tuple(r) for r in found)
    sizes = collections.Counter(len(WORD.findall(t)) for _, t in plain)
    assert collections.Counter(r.size for r in found) == sizes and all(r.taken <= 3 * r.size for r in found)
    by = {}
    for r in found:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - sum(len(WORD.findall(t)) for _, t in plain)) < 1 or len(by) < len({r.source for r in docs.collect()})
    assert mixing.mix(docs).count() == sum(r.copies for r in found)


def test_jaccard(docs, plain):
    sets = {}
    for d, text in plain:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common_ = len(sets[a] & sets[b])
        if common_ and 100 * common_ >= 85 * (len(sets[a]) + len(sets[b]) - common_) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = jaccard.jaccard_components(docs).collect()
    assert collections.Counter(tuple(r) for r in found) == collections.Counter((d, len(sets[d]), root(d)) for d, _ in plain)


@pytest.mark.parametrize("words, percent", [(4, 50), (4, 60), (5, 80), (2, 30)])
def test_jaccard_of_nested_sets(spark, words, percent):
    """No link is lost at any percent: sets that hold one another, and edited ones."""
    random.seed(percent)
    rows = []
    for g in range(14):
        whole = [f"w{random.randrange(10**6)}" for _ in range(random.choice([12, 40, 90, 300]))]
        for share in (1, 0.9, 0.8, 0.7, 0.62, 0.55, 0.5, 0.35):
            rows.append((len(rows), whole[: max(1, int(len(whole) * share))]))
        rows.append((len(rows), [w if random.random() > 0.03 else "edited" for w in whole]))
    sets = {i: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or {tuple(w)} for i, w in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = jaccard.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), words=words, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: root(i) for i in sets}


def test_jaccard_null_ids(spark):
    """Sets that only rows of null id hold link as others do."""
    words = [f"w{i}" for i in range(200)]
    near, other = [*words[:-1], "x"], [f"v{i}" for i in range(100)]
    rows = [(7, words), (None, near), (None, near), (None, other), (None, [*other[:-1], "y"]), (9, ["a"] * 3)]
    found = jaccard.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in found) == {(7, 7): 1, (None, 7): 2, (None, None): 2, (9, 9): 1}


def test_toxicity(spark):
    docs, labels = common.read(spark, "/root/testdata/sf0.1", "documents"), common.read(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.learn(docs, labels)
    restorer = toxicity.Restorer(model.table)
    for token, word in ((b"1d10t", b"idiot"), (b"m0r0n", b"moron"), (b"w.o.r.t.h.l.e.s.s", b"worthless"), (b"5tup1d", b"stupid"), (b"idiooot", b"idiot"), (b"i d i o t", b"idiot"), (b"st*pid", b"stupid")):
        assert restorer.decode(token) == word
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in found if r.toxic == 1]
    wrong = [r.predicted for r in found if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.01
    empty = toxicity.toxicity(docs.where("doc_id < 3").withColumn("text", F.lit(None).cast("string")), labels.where("false")).collect()
    assert {r.predicted for r in empty} == {0}


def test_toxicity_spelled_apart(spark):
    """Runs beside single-letter words, several words in one run, and tokens and runs of any length."""
    table = toxicity.trigram_table(common.read(spark, "/root/testdata/sf0.1", "documents"))
    model, restorer = toxicity.Model(table, {b"widiot": 8.0, b"wworthless": 8.0}, -4.0), toxicity.Restorer(table)
    apart = lambda x, sign=" ": sign.join(x.replace(" ", "")).encode()
    for text in (
        b"you are " + apart("a idiot"), apart("i am a idiot"), apart("stupid idiot") + b" he said", apart("idiot i say"),
        apart("you are a worthless moron and a stupid idiot who knows nothing"), apart("worthless worthless idiot", "."),
        b"an idi" + b"o" * 60 + b"t", b"an 1d10t" + b"t" * 300, b"x " + apart("well " * 400 + "you idiot"),
    ):
        assert model.score(restorer, text) > 0.9, text
    for text in (b"you are a pilot", apart("you are a pilot"), b"a" + b"*" * 500 + b"b", apart("well " * 400)):
        assert model.score(restorer, text) < 0.1, text
    assert b"idiot" in restorer.words(apart("stupid idiot"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    found = queries.queries()[name](spark, SF)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected(queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("operator", [licenses.license_scan, suffix_dedup.repeats, packing.pack, token_store.store_and_read, fingerprints.fingerprints, mixing.mix_plan, jaccard.jaccard_components])
def test_empty_table(docs, operator):
    assert operator(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Rows with clashing column names, repeated ids and rows, nulls and empties."""
    names = ["row_number", "run_starts", "toxicity", "mix_copies", "sequence_key", "id_or_zero", "mix_id"]
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(90))
    more = [(1 << 40, text, "en", "s", 1), (1 << 41, text, "en", "s", 1), (1 << 41, other, "en", "s", 1), (None, text, None, None, None), (None, other + " z", None, None, None), (1 << 42, None, "en", "s", 0)]
    rows = base.unionByName(spark.createDataFrame(more, base.schema))
    return rows.select("*", *(F.lit(f"kept {n}").alias(n) for n in names))


def _five(text):
    w = [("".join(c.lower() if "A" <= c <= "Z" else c for c in x)) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_drop_near_duplicates(odd):
    """One row of each component of the five-word, 0.8 form stays, by brute force over rows."""
    rows = odd.collect()
    sets = [_five(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        groups[root(i) if s else ("none", i)].append(i)
    found = jaccard.drop_near_duplicates(odd, words=5, percent=80)
    assert found.columns == odd.columns
    kept = collections.Counter((r.doc_id, r.text) for r in found.collect())
    assert sum(kept.values()) == len(groups)
    for some in groups.values():
        least = min((rows[i].doc_id is None, rows[i].doc_id or 0) for i in some)
        assert any(kept[rows[i].doc_id, rows[i].text] for i in some if (rows[i].doc_id is None, rows[i].doc_id or 0) == least)
    assert all(r.mix_id == "kept mix_id" and r.sequence_key == "kept sequence_key" for r in found.collect())


def test_drop_repeats(odd):
    """Kept texts are those of the digests, and columns stay."""
    small = odd.where("doc_id is null or doc_id < 100 or doc_id >= 10000")
    want, digests = collections.Counter(), collections.Counter()
    for r in suffix_dedup.repeats(small).collect():
        if r.n_bytes > r.n_removed or not r.n_bytes:
            want[r.doc_id] += 1
            digests[r.doc_id, r.kept_sha256] += 1
    found = suffix_dedup.drop_repeats(small, length_column="n_chars").collect()
    assert collections.Counter(r.doc_id for r in found) == want
    # no character is cut in two in a text of single bytes: what is left is what the digest is of
    whole = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in found if (r.text or "").isascii())
    plain_ids = {r.doc_id for r in small.collect() if (r.text or "").isascii()}
    assert sum(whole.values()) > 50 and all(digests[k] == n for k, n in whole.items() if k[0] in plain_ids)
    assert all(r.n_chars == len(r.text) for r in found if r.text and r.doc_id is not None and r.doc_id < 100)
    assert all(r.row_number == "kept row_number" and r.run_starts == "kept run_starts" for r in found)


def test_drop_toxic_and_mix(odd, spark):
    labels = common.read(spark, "/root/testdata/sf0.1", "labels")
    scores = {(r.doc_id): r.predicted for r in toxicity.toxicity(odd, labels).collect()}
    found = toxicity.drop_toxic(odd, labels)
    assert found.columns == odd.columns and all(r.toxicity == "kept toxicity" for r in found.collect())
    assert collections.Counter((r.doc_id, r.text, r.source) for r in found.collect()) == collections.Counter((r.doc_id, r.text, r.source) for r in odd.collect() if not scores[r.doc_id])
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and {r.mix_copies for r in taken.collect()} == {"kept mix_copies"}
    assert taken.count() == mixing.mix_plan(odd).agg(F.sum("copies")).first()[0]


def test_mixing_targets(docs):
    """Targets are those of the plain filling, source by source; each source's words come near its target."""
    rows = docs.collect()
    sizes, by = collections.Counter(), collections.defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    found = {(r.source_size, round(r.target, 6)) for r in mixing.mix_plan(docs).collect()}
    assert found == {(sizes[s], round(target[s], 6)) for s in order}
    taken = {}
    for r in mixing.mix_plan(docs).collect():
        taken[r.source_size, round(r.target, 6)] = taken.get((r.source_size, round(r.target, 6)), 0) + r.taken
    if len({sizes[s] for s in order}) == len(order):
        for s in order:
            longest = max(len(WORD.findall(r.text or "")) for r in rows if r.source == s)
            assert abs(taken[sizes[s], round(target[s], 6)] - target[s]) <= longest + 1


def test_quality_verdict(docs, plain, spark):
    """kept and llr by a plain computation over the same buckets."""
    trusted = {r.doc_id for r in common.read(spark, SF, "labels").where("quality = 1").collect()}
    words = spark.createDataFrame(sorted({(w,) for _, t in plain for w in WORD.findall(t)}), "w string")
    one = {r.w: r.h for r in words.select("w", F.pmod(F.xxhash64("w"), F.lit(quality.BUCKETS)).alias("h")).collect()}
    pairs = spark.createDataFrame(sorted({(a, b) for _, t in plain for a, b in itertools.pairwise(WORD.findall(t))}), "a string, b string")
    two = {(r.a, r.b): r.h for r in pairs.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(quality.BUCKETS)).alias("h")).collect()}
    grams = [(d, [one[w] for w in WORD.findall(t)] + [two[p] for p in itertools.pairwise(WORD.findall(t))], len(WORD.findall(t))) for d, t in plain]
    raw, good = collections.Counter(), collections.Counter()
    for d, g, _ in grams:
        raw.update(g)
        if d in trusted:
            good.update(g)
    ratio = [round(np.log((good[b] + 1) / (sum(good.values()) + quality.BUCKETS)) - np.log((raw[b] + 1) / (sum(raw.values()) + quality.BUCKETS)), 6) for b in range(quality.BUCKETS)]
    means = collections.defaultdict(list)
    for d, g, n in grams:
        means[d].append((sum(ratio[b] for b in g) / len(g) if g else 0.0, n))
    steps = sorted(int(np.floor(m * quality.STEPS + 1e-9)) for d, ms in means.items() if d in trusted for m, n in ms if n >= 50)
    floor = steps[int(quality.TRUSTED_LOSS * len(steps))] / quality.STEPS
    for r in quality.quality(docs, spark.createDataFrame([(d,) for d in trusted], "doc_id long")).collect():
        assert any(abs(r.llr - m) < 1e-4 and (r.base_failed or abs(m - floor) < 2e-3 or r.kept == (m >= floor)) for m, _ in means[r.doc_id])


def test_fingerprint_likeness(docs):
    """near_* are within a step of the share that common beginning and ending cover."""
    rows = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id < 10000").collect()), reverse=True)
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs.where("doc_id < 10000")).collect()}

    def share(a, b):
        if a == b:
            return 1.0, 0.0
        n, m = len(a), len(b)
        p = next((i for i in range(min(n, m)) if a[i] != b[i]), min(n, m))
        s = next((i for i in range(min(n, m)) if a[n - 1 - i] != b[m - 1 - i]), min(n, m))
        return min(1.0, (p + s) / max(n, m, 1)), 2 * max(fingerprints.step_of(n), fingerprints.step_of(m)) / max(n, m, 1)

    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        for other, near in ((edited, found[d].near_edited), (after, found[d].near_next)):
            exact, slack = share(text, other)
            assert exact - slack <= near <= exact + 1e-9
        assert text[: found[d].edited_prefix] == edited[: found[d].edited_prefix] and text[: found[d].edited_prefix + 1] != edited[: found[d].edited_prefix + 1] or text == edited


def test_pipeline(spark):
    """run() is its stages in turn; sequences are filled without gaps, and no two pieces of a copy overlap."""
    import corpus_pipeline

    docs, kept = common.read(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == before.columns
        kept.append(docs.count())
    words = mixing.mix_plan(common.read(spark, SF, "documents")).agg(F.sum("taken")).first()[0]
    assert kept[0] >= kept[1] >= kept[2] > 0 and words > 0
    import public_tokenizers
    import tokenizers

    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = docs.collect()
    copies, tokens = collections.Counter(r.doc_id for r in mixed), {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed}
    at, heads, lengths = {}, collections.Counter(), collections.Counter()
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset and r.doc_tokens == tokens[r.doc_id]
        at[r.sequence_id] = r.offset + r.length
        heads[r.doc_id] += r.start == 0
        lengths[r.doc_id] += r.length
    assert max(at.values()) <= 2048
    assert heads == copies and lengths == {d: n * tokens[d] for d, n in copies.items()}  # what the stages kept, as often as the mix takes it, whole


def test_empty_tables_of_the_others(spark, docs):
    none = docs.where("false")
    labels = common.read(spark, SF, "labels")
    assert quality.quality(none, labels.select("doc_id")).count() == 0 and toxicity.toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(none, labels).count() == 0 and jaccard.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0 and mixing.mix(none).count() == 0
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (4, 100)])
def test_jaccard_of_equal_small_sets(spark, words, percent):
    """Other sequences of words with one set of few shingles are linked, whatever their lengths."""
    texts = ["a " * 7, "a " * 9, "b c d e f " * 3, "b c d e f " * 4, "b c d e f " * 4 + "b", "a a", "a", "g h i j k l m n", "g h i j k l m o p"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, words=words, percent=percent).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 7, 8: 8}
    assert sorted(r.doc_id for r in jaccard.drop_near_duplicates(docs, words=words, percent=percent).collect()) == [0, 2, 5, 6, 7, 8]


def test_trusted_rows_meet_by_a_merge_join(spark, docs, monkeypatch):
    """Ids of trusted rows are sent to no task whole, however few they are."""
    plans, keep = [], quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    quality.quality(docs, docs.select("doc_id").limit(5))
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_large_texts_with_a_passage_in_common_are_no_pairs(spark):
    """Parities tell large sets apart in the join of a bucket already, and never sets that are linked."""
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=7))
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(2000)] for _ in range(5)]
    texts.append([*texts[0][:1900], *(word() for _ in range(160))])  # linked with the first
    rows = [(i, zstandard.ZstdCompressor().compress(" ".join(t).encode())) for i, t in enumerate(texts)]
    sets = next(jaccard._sets(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["node", "text"])]), 5))
    facts = spark.createDataFrame(sets.drop_columns(["text", "parity"]).to_pylist(), "node long, n long, folded array<long>, fine array<long>")
    pairs = facts.withColumnsRenamed({c: f"{c}_a" for c in facts.columns}).join(facts, F.col("node_a") < F.col("node")).where(jaccard._may_link(80))
    assert [(r.node_a, r.node) for r in pairs.collect()] == [(0, 5)]


def test_a_passage_in_common_makes_no_buckets(spark, monkeypatch):
    """Sets leave out the signatures that they can spare, so texts that have a passage in common don't meet in its buckets; linked ones still do."""
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefgh", k=7))
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(300)] for _ in range(60)]
    texts.append([*texts[0][:330], *(word() for _ in range(30))])  # linked with the first
    rows, keep = {}, jaccard.materialise

    def counted(df, name):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name in ("led", "apart") else 0)
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = jaccard.jaccard_components(docs, words=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i == 60 else i for i in range(61)}
    assert rows["led"] + rows["apart"] < 60


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_sets_at_the_bound_share_a_signature(percent):
    """Whatever each of two linked sets spares, a signature is left that both have, also after the second half by any one order."""
    draw = np.random.default_rng(percent)
    for n in [*range(12, 60, 3), *range(60, 1500, 97)]:
        for m in {n, (n + n * 100 // percent) // 2, n * 100 // percent}:
            common_ = -(-percent * (n + m) // (100 + percent))  # the fewest that link
            if common_ > n:
                continue
            pool = draw.integers(1, 1 << 62, n + m - common_, dtype=np.uint64)
            left = []
            for part in (pool[:n], pool[n - common_ :]):
                signs, spare = jaccard.signatures(part, percent)
                kept = set()
                for band in np.unique(signs & np.uint64(255)):
                    mine = (signs & np.uint64(255)) == band
                    order = np.argsort(common.mix(signs[mine]))
                    kept |= set(signs[mine][order][spare[mine][0] :].tolist())
                left.append(kept)
            assert left[0] & left[1]
