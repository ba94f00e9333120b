"""Merkle manifest of a table: a tree of digests for each source, a tree over the sources, proofs for every row.

A node is the SHA-256, in hex, of its inputs one after another. Leaves are the rows' own digests; ARITY consecutive
nodes become one until a single one is left, a source's subroot; the subroots, in order of their sources, likewise give the root.

Only every second level is stored (the leaves, then levels 2, 4, ...): a stored node stands for an aligned subtree of
ARITY * ARITY stored nodes below it. Proofs are made from the top down: each aligned subtree is read again,
its missing level is regenerated in the task that reads it, the siblings of its nodes are appended to the path of the
node above, and the regenerated level is forgotten. A task never holds more than one subtree's digests,
so a source of any size is spread over as many tasks as it has subtrees.

Positions come from a range sort by source, id and digest: a count for each range and source gives each range its first position, so no
source is numbered in one task. A column written beside the leaves keeps rows apart that agree in all of these.

Cases: nulls of any column are `-`; a null source is first, null ids are first in their source. Rows that agree in everything are leaves of their
own, rows of one id are ordered by their digest. An empty table has no rows and no root. Texts are read once and don't travel. Other columns than the named ones
aren't looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, release

ARITY = 16
SUBTREE = ARITY * ARITY  # stored nodes below a stored node
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """levels: the stored levels of the sources' trees (tree, pos, h, size; the leaves with their payload), the last with a row for each source.

    tops: those of the tree over the sources, the last with the root alone.
    """

    levels: list[DataFrame]
    tops: list[DataFrame]

    @property
    def root(self) -> str | None:
        found = self.tops[-1].select("h").first()
        return found and found["h"]


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(p), F.lit(":"), p), F.lit("-")) for p in (part.cast("string") for part in parts)]
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (left and right siblings of each level) give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (from 0, in order) and size of each row of a tree. rows: tree and the columns of order, which tell all rows apart."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # of the sorted range: its number, then the row's place in it
    placed = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("place", place)
    placed = materialise(placed.withColumn("range", F.shiftright("place", 33)), "ordered")
    runs = placed.groupBy("tree", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("range")) - F.col("n")  # a row for each range that a tree is in
    runs = runs.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    runs = materialise(runs, "ranges")  # so that its size is known and Spark broadcasts it where it is small
    out = placed.join(runs, ["tree", "range"]).withColumn("pos", F.col("place") + F.col("shift"))
    return out.drop("place", "range", "shift")


def _subtrees(level: DataFrame, payload: list[str]) -> DataFrame:
    """tree, block, size, nodes of each aligned subtree of a level; mid: its regenerated level, empty where the nodes' parent is the top; top: its digest."""
    nodes = F.sort_array(F.collect_list(F.struct("pos", "h", *payload)))  # SUBTREE at most
    found = level.groupBy("tree", F.floor(F.col("pos") / SUBTREE).alias("block"), "size").agg(nodes.alias("nodes"))
    runs = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / ARITY).cast("int"))
    mid = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice("nodes.h", i * ARITY + 1, F.lit(ARITY)), ""), 256))
    found = found.withColumn("mid", F.when(F.col("size") > ARITY, mid).otherwise(F.array().cast("array<string>")))
    above = F.sha2(F.array_join(F.when(F.col("size") > ARITY, F.col("mid")).otherwise(F.col("nodes.h")), ""), 256)
    return found.withColumn("top", F.when(F.col("size") > 1, above).otherwise(F.col("nodes.h")[0]))


def _grown(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels over leaves (tree, pos, h, size), up to one node a tree."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        up = F.when(F.col("size") > ARITY, F.ceil(F.col("size") / SUBTREE)).otherwise(1).cast("long")
        above = _subtrees(levels[-1], []).select("tree", F.col("block").cast("long").alias("pos"), F.col("top").alias("h"), up.alias("size"))
        levels.append(materialise(above, f"{name}-level-{2 * len(levels)}"))
        most = -(-most // SUBTREE) if most > ARITY else 1
    return levels


def _sides(digests: Column, i: Column) -> Column:
    """The siblings at the left and at the right of place i (from 0) in its run of ARITY."""
    first = F.floor(i / ARITY).cast("int") * ARITY
    last = F.least(first + ARITY, F.size(digests))
    return F.struct(F.array_join(F.slice(digests, first + 1, i - first), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.greatest(last - i - 1, F.lit(0))), "").alias("right"))


def _paths(levels: list[DataFrame], above: DataFrame, payload: list[str], name: str) -> DataFrame:
    """tree, pos, h, payload, path of each leaf. above: tree and the path of its top; its other columns come along."""
    along = [c for c in above.columns if c not in ("tree", "path")]
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for depth in range(len(levels) - 2, -1, -1):
        more = payload if not depth else []
        found = _subtrees(levels[depth], more).drop("top").join(paths.withColumnRenamed("path", "upper"), ["tree", "block"])
        rows = found.select("tree", *along, "size", "upper", "mid", F.col("nodes.h").alias("digests"), F.posexplode("nodes").alias("i", "node"))
        here, run = _sides(F.col("digests"), F.col("i")), _sides(F.col("mid"), F.floor(F.col("i") / ARITY).cast("int"))
        levels_here = F.when(F.col("size") > ARITY, F.array(here, run)).when(F.col("size") > 1, F.array(here)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
        paths = rows.select("tree", *along, F.col("node.pos").alias("pos"), F.col("node.h").alias("h"), *(F.col(f"node.{c}").alias(c) for c in more), F.concat(levels_here, "upper").alias("path"))
        if depth:  # one path for a whole subtree of rows
            paths = materialise(paths.select("tree", *along, F.col("pos").alias("block"), "path"), f"{name}-paths-{2 * depth}")
    if len(levels) == 1:
        paths = levels[0].join(above, "tree").select("tree", *along, "pos", "h", *payload, "path")
    return paths


def build(leaves: DataFrame, payload: list[str]) -> Manifest:
    """The manifest of leaves (source, h, payload): ordered within a source by the payload's first column, then by h. All stored levels are written."""
    spark = leaves.sparkSession
    # a null source is a tree of its own, before all others; Spark compares strings by their bytes
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    rows = materialise(leaves.select(tree.alias("tree"), "h", *payload).withColumn("own", F.monotonically_increasing_id()), "leaves")
    release(spark)
    levels = _grown(materialise(_numbered(rows, [payload[0], "h", "own"]).drop("own"), "level-0"), "tree")
    discard(rows)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h")
    return Manifest(levels, _grown(materialise(_numbered(subroots, ["of"]), "top-0"), "top"))


def proofs(manifest: Manifest, payload: list[str]) -> DataFrame:
    """h, payload, subroot and path (to the root) of every leaf."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = manifest.tops[-1].select("tree", none.alias("path"))
    subroots = materialise(_paths(manifest.tops, top, ["of"], "top").select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "path"), "subroots")
    # the path of a source's top, then its own
    return _paths(manifest.levels, subroots.select("tree", "path", "subroot"), payload, "tree").drop("tree", "pos")


def tampered(docs: DataFrame) -> DataFrame:
    """docs with the leaf h and tampered_h: the leaf of the row with its text's A-Z lower-cased where 5 divides the crc32 of the decimal id."""
    fields = lambda text: digest(*(text if c == "text" else F.col(c) for c in FIELDS))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", "source", fields(F.col("text")).alias("h"), F.when(hit, fields(F.translate("text", _UPPER, _LOWER))).alias("tampered_h"))


def manifest_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row: its proof, and whether the tampered table still folds to the root."""
    payload = ["doc_id", "tampered_h"]
    made = build(tampered(docs), payload)
    root = made.root
    rows = proofs(made, payload).withColumn("folded_root", folded(F.coalesce("tampered_h", "h"), F.col("path")))
    return rows.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def stored(spark: SparkSession, manifest: Manifest, path: str) -> None:
    """Keeps a manifest's stored levels below path."""
    for kind, tables in zip(Manifest._fields, manifest, strict=True):
        for i, table in enumerate(tables):
            table.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{kind}/{i:02d}")


def opened(spark: SparkSession, path: str) -> Manifest:
    """A manifest that stored() has kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for kind in Manifest._fields:
        names = sorted(x.getPath().getName() for x in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")))
        found.append([spark.read.parquet(f"{path}/{kind}/{name}") for name in names])
    return Manifest(*found)
