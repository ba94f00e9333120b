"""Models, building, versions of an index, and the exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunks, index
from corpusloom.sources import versions


def stub(size=4, forbidden=None):
    """A model that fails where it is asked for a text that it must not see."""

    def load():
        def encode(texts):
            if forbidden is not None and any(forbidden not in t for t in texts):
                raise AssertionError("embedded a text that was embedded before")
            return np.array([[len(t), t.count("a"), 1, 0] for t in texts], dtype=float)[:, :size]

        return encode

    return index.Model("stub", size, load)


def desired(spark, rows):
    return chunks.described(spark.createDataFrame([(f"c{n:03d}", f"{n}", t, "CrPC", "note", i) for i, (n, t) in enumerate(rows)], "chunk_id string, section_number string, text string, document string, marginal_note string, ord int"), "document", "section_number", "marginal_note", "text")


ROWS = [(n, f"text {n} of the act") for n in range(40)]


def test_build(spark):
    found = index.build(desired(spark, ROWS), stub()).collect()
    assert len(found) == 40
    for r in found:
        want = np.array([len(r.embedding_text), r.embedding_text.count("a"), 1, 0])
        assert np.allclose(r.vector, want / np.linalg.norm(want), atol=1e-6)
    zero = index.Model("zero", 3, lambda: lambda texts: np.zeros((len(texts), 3)))
    assert [r.v for r in spark.createDataFrame([("x",), (None,)], "t string").select(index.embedding(F.col("t"), zero).alias("v")).collect()] == [[0.0] * 3] * 2
    wrong = index.Model("wrong", 5, lambda: lambda texts: np.zeros((len(texts), 3)))
    with pytest.raises(Exception, match="vectors of shape"):
        index.build(desired(spark, ROWS), wrong).collect()
    hashed = index.build(desired(spark, ROWS), index.hashing(16)).collect()
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in hashed)


def test_only_changed_chunks_are_embedded(spark):
    old = index.build(desired(spark, ROWS), stub()).select("chunk_id", "content_hash", "vector")
    new = desired(spark, [*ROWS[:10], (10, "NEW words"), *ROWS[11:39], (77, "NEW too")])
    found = {r.chunk_id: r for r in index.converge(old, new, stub(forbidden="NEW")).collect()}
    assert len(found) == 40 and {c for c, r in found.items() if not r.reused} == {"c010", "c077"}
    before = {r.chunk_id: r.vector for r in old.collect()}
    assert all(r.vector == before[c] for c, r in found.items() if r.reused)
    with pytest.raises(ValueError, match="c003 comes twice"):
        index.converge(old, new.unionByName(new.where("chunk_id = 'c003'")), stub())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    first = versions.create(desired(spark, ROWS), path, stub(), parts=8)
    assert (first.number, first.count, len(first.folders)) == (1, 40, 8) and versions.read(spark, path).count() == 40
    with pytest.raises(versions.Refused):
        versions.create(desired(spark, ROWS), path, stub())
    same, report = versions.converge(desired(spark, ROWS), path, stub(forbidden="nothing"))
    assert report["unchanged"] == 40 and same.folders == first.folders and same.fingerprint == first.fingerprint
    # an amendment to one section: one chunk embedded, one part written
    words = desired(spark, ROWS).select("chunk_id", "section_number", "text", "document", "marginal_note", "ord")
    changed = chunks.described(index.amended(words, "7", "AMENDED words"), "document", "section_number", "marginal_note", "text")
    amended, report = versions.converge(changed, path, stub(forbidden="AMENDED"))
    assert (report["changed"], report["added"], report["removed"]) == (1, 0, 0) and amended.fingerprint != first.fingerprint
    assert sum(amended.folders[p] != first.folders[p] for p in first.folders) == 1
    assert versions.read(spark, path).where("section_number = '7'").first()["text"] == "AMENDED words"
    assert versions.read(spark, path, 1).where("section_number = '7'").first()["text"] == ROWS[7][1]
    with pytest.raises(ValueError, match="section 999"):
        index.amended(words, "999", "x")
    back = versions.revert(spark, path, 1)
    assert back.number == 4 and back.fingerprint == first.fingerprint and versions.read(spark, path).where("section_number = '7'").first()["text"] == ROWS[7][1]
    # a write that breaks leaves the version before it
    broken = index.Model("stub", 4, lambda: lambda texts: 1 / 0)
    with pytest.raises(Exception, match="division"):
        versions.converge(changed, path, broken)
    assert versions.versions(spark, path) == [1, 2, 3, 4] and versions.read(spark, path).count() == 40
    # rebuilds, other models and lost races are refused; a dry run writes nothing
    with pytest.raises(versions.Refused, match="rebuild"):
        versions.converge(desired(spark, ROWS[:20]), path, stub())
    none, report = versions.converge(desired(spark, ROWS[:35]), path, stub(), dry=True)
    assert none is None and report["removed"] == 5 and versions.versions(spark, path) == [1, 2, 3, 4]
    with pytest.raises(versions.Refused, match="made with"):
        versions.converge(changed, path, index.hashing(4))
    with pytest.raises(versions.Refused, match="another writer"):
        versions._publish(spark, path, back)
    less, report = versions.converge(desired(spark, ROWS[:10]), path, stub(), force=True)
    assert (less.count, report["removed"]) == (10, 30) and versions.read(spark, path).count() == 10
    none, _ = versions.converge(desired(spark, ROWS[:10]).where("false"), path, stub(), force=True)
    assert none.count == 0 and none.folders == {} and versions.read(spark, path).count() == 0


def test_facts_of_unchanged_chunks_are_refreshed(spark, tmp_path):
    path = str(tmp_path / "index")
    versions.create(desired(spark, ROWS), path, stub(), parts=4)
    renamed = desired(spark, ROWS).withColumn("marginal_note", F.when(F.col("chunk_id") == "c001", "another").otherwise(F.col("marginal_note")))
    _, report = versions.converge(renamed, path, stub(forbidden="nothing"))
    assert report["changed"] == 0 and versions.read(spark, path).where("marginal_note = 'another'").count() == 1


def test_top_k(spark, monkeypatch):
    """Against brute force: ties by id, many equal vectors, nulls, other lengths, queries in many blocks."""
    draw = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in draw.integers(-2, 3, 6) / 4]) for i in range(500)] + [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0]), (2003, [])]
    queries = [(i, v) for i, v in vectors[:60]] + [(9000, [2.0]), (9001, None), (9002, [])]
    want = []
    for q, a in queries:
        if a:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if b is not None and None not in b and len(b) == len(a))
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:7], 1)]
    asked = spark.createDataFrame(queries, "qid long, qvec array<float>")
    table = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, place int").repartition(5)
    found = lambda: sorted(tuple(r) for r in index.top_k(asked, table, 7).collect())
    assert found() == sorted(want)
    monkeypatch.setattr(index, "QUERY_BYTES", 400)
    assert found() == sorted(want)
    assert index.top_k(asked.where("false"), table, 7).collect() == [] and index.top_k(asked, table.where("false"), 7).collect() == []


def test_digest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), (None, None, None)], "g string, id int, h string")
    one = {r.g: r.digest for r in index.digest(rows, ["g"], "id", "h").collect()}
    again = {r.g: r.digest for r in index.digest(rows.repartition(3).orderBy(F.desc("id")), ["g"], "id", "h").collect()}
    other = {r.g: r.digest for r in index.digest(rows.withColumn("h", F.lit("x")), ["g"], "id", "h").collect()}
    assert one == again and one["a"] != other["a"] and one["b"] == other["b"] and len(one) == 3
    mixed = spark.createDataFrame([("d", "legal_aware"), ("d", "naive_fixed_size"), ("e", "schedule_rows")], "document string, strategy string")
    with pytest.raises(ValueError, match="mixed strategies in d"):
        index.shape(mixed).select("with_schedule")
