"""Whitening and Merkle manifests against plain computations, with nulls, ragged vectors, repeated rows, ties and clashing names."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import common, manifest, spectral, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 33])
@pytest.mark.parametrize("kind", ["random", "integers", "equal", "two", "steep", "zero"])
def test_spectral(n, kind):
    draw = np.random.default_rng(n)
    q, _ = np.linalg.qr(draw.standard_normal((n, n)))
    e = {"random": draw.random(n), "integers": np.arange(n) + 1.0, "equal": np.ones(n), "two": np.r_[np.ones(n // 2), np.zeros(n - n // 2)], "steep": 10.0 ** -np.arange(n), "zero": np.zeros(n)}[kind]
    a = (q * e) @ q.T
    values, vectors = spectral.eigen(a, 4)
    k = min(4, n)
    assert np.allclose(values[:k], np.sort(e)[::-1][:k], atol=1e-13)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-13)


def _plain(rows, number=4):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return {}
    width = max(len(v) for _, v in rows)
    x = [tuple(math.floor(256 * c) for c in v) + (0,) * (width - len(v)) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, dtype=float) - np.array(sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), v in zip(rows, x, strict=True):
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), (np.array(v) - np.array(sums) / n) @ u[:, :number] / np.sqrt(np.maximum(e[:number], 1e-300)), e[:number] / e.sum()))
    return out


def test_whitening(spark):
    common.tune(spark)
    rows = [(r.vec_id, list(r.embedding)) for r in common.read(spark, SF, "embeddings").collect()]
    rows += [(rows[5][0], rows[5][1])] * 300 + [(90_001, None), (90_002, [0.1, None]), (90_003, [math.nan] * 64), (90_004, [math.inf] * 64), (90_005, [0.5, -0.25]), (90_006, []), (None, rows[7][1])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, length int")
    want = _plain([(i, [np.float32(c) if c is not None else None for c in v] if v is not None else None) for i, v in rows])
    found = {}
    for r in whitening.components(table.repartition(7)).collect():
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(found) == set(want)
    sign = {}
    for i, parts in found.items():
        assert sorted(parts) == [1, 2, 3, 4]
        n, deviation, values, shares = want[i][0]
        for c, own in parts.items():
            assert len(own) == len(want[i])
            for r in own:
                assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, shares[c - 1], rel_tol=1e-9) and r.identity_error < 1e-9
                if abs(r.whitened) > 1e-3:
                    s = sign.setdefault(c, np.sign(r.whitened) * np.sign(values[c - 1]))
                    assert math.isclose(r.whitened, s * values[c - 1], rel_tol=1e-7)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.components(spark.createDataFrame([], schema)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, [])], schema)).collect() == []
    # one direction of three; then none at all
    one = whitening.components(spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])], schema)).collect()
    assert [(r.component, r.whitened and round(abs(r.whitened), 9), round(r.explained, 9)) for r in sorted(one)] == [(1, 1.0, 1.0), (2, None, 0.0), (3, None, 0.0)] * 2
    assert all(r.deviation == 3 * 256**2 and r.identity_error < 1e-9 for r in one)
    none = whitening.components(spark.createDataFrame([(1, [0.5, 0.5])] * 3, schema)).collect()
    assert len(none) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and (r.n, r.deviation) == (1, 0) for r in none)
    # entries beyond what whole numbers of 64 bits can multiply
    big = whitening.components(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e12, 3.0]), (3, [1e12, 5.0])], schema)).collect()
    assert len(big) == 6 and {r.vec_id for r in big if r.deviation is None} == {1, 2, 3}


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return _h(*said)


def _tree(nodes):
    """The root, and for each node its siblings at the left and right level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 16 * 16
            paths[i].append((nodes[run:p], nodes[p + 1 : run + 16]))
        nodes = [_h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], paths


def _manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:3]), *_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in order}
    root, tops = _tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        leaves, subroot, paths = trees[s]
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = _leaf(*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if hit else leaf
            for left, right in path:
                h = _h(*left, h, *right)
            out.append((r[0], leaf, subroot, root, _h(*(x for left, right in path for x in (*left, *right))), h, h == root))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_manifest(spark):
    common.tune(spark)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in common.read(spark, SF, "documents").collect()]
    rows += [(1000 + i, "hot", "en", i, f"Text {i}") for i in range(600)] + [(5000 + i, "next", None, None, None) for i in range(257)] + [(6000 + i, "run", "de", 1, "Ä B") for i in range(17)]
    rows += [(7000, "one", "en", 3, "A é B"), (None, None, None, None, None), (None, "hot", "en", 0, ""), (8000, None, "x", -1, "Z")] + [(9000, "é", "en", 1, "Same")] * 40 + [(9001, "", "en", 1, "b"), (9001, "", "en", 1, "a")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, h string, pos int")
    want = _manifest(rows)
    found = manifest.manifest_check(table.repartition(5))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _rows(found) == want
    assert 0 < sum(not r[6] for r in want) < len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", i, "Ab") for i in range(n)]
    assert _rows(manifest.manifest_check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == (_manifest(rows) if n else [])


def test_manifest_is_kept(spark, tmp_path):
    """A stored manifest, opened again, gives the same root and proofs; only every second level is stored."""
    docs = spark.createDataFrame([(i, f"s{i % 2}", "en", i, "Ab") for i in range(700)], "doc_id long, source string, lang string, n_chars long, text string")
    made = manifest.build(manifest.tampered(docs), ["doc_id"])
    assert [t.count() for t in made.levels] == [700, 4, 2] and [t.count() for t in made.tops] == [2, 1]
    manifest.stored(spark, made, str(tmp_path / "m"))
    again = manifest.opened(spark, str(tmp_path / "m"))
    assert again.root == made.root
    bad = manifest.proofs(again, ["doc_id"]).where(manifest.folded(manifest.F.col("h"), manifest.F.col("path")) != made.root)
    assert bad.count() == 0 and manifest.proofs(again, ["doc_id"]).count() == 700
