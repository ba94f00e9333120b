"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source has the same copy expectation, its source's target over its size. The whole part is
given to each; the fractional parts are rounded dependently. Pairs transfer mass, measured in words, so that a
source's expected words stay as they are and each document's expectation stays what it was, until one of a pair
is 0 or 1. A block of a source's documents is folded that way and leaves at most one fractional
document; those of all blocks are blocked and folded again, a reduction tree, until each source has one
at most, which is rounded by itself. Documents above 1 / LONG of their source are rounded
first, and the expectations of the others shift by what that added or lacked. A source's words thus miss
its target by less than that part of it, as long as its shorter documents can make up for the long ones.

Chance is a hash of the document, level and seed: reruns agree. Blocks have BLOCK rows about, whatever
share of the rows a source has.

Cases: null texts have size 0 and are never taken, as are empty ones; null sources are one source, last in
order. Repeated rows are rounded each for itself. All sizes 0: all targets 0. An empty table gives an empty
result. Columns beside the named ones are dropped from mix_plan, kept by mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, fresh, materialise

# Weights of the sources, repeating in their order.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 200
#: A document of more than this part of its source's words is long.
LONG = 100
_UNIT = "struct<size:bigint,key:bigint,doc_id:bigint,ordinal:bigint,p:double,taken:int>"


def words_of(text: F.Column) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(text, BLANK), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n, target of each source of (source, size) rows.

    Shares by weight stop at most times a source's size, and the excess is shared anew: so all targets below their
    cap are one level times their weight. With the sources ordered by cap over weight, those before a point are
    capped, and the level is that of the first point at which the next source isn't. One row for each source is windowed.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    by = by.withColumn("level", level)
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    return by.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "n", "target")


def _chance(key: F.Column, other: F.Column, level: int, seed: int) -> F.Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(key, other, F.lit(level), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _unit(size: F.Column, key: F.Column, doc_id: F.Column, ordinal: F.Column, p: F.Column, taken: F.Column) -> F.Column:
    return F.struct(size.alias("size"), key.alias("key"), doc_id.alias("doc_id"), ordinal.alias("ordinal"), p.alias("p"), taken.alias("taken"))


def _fold(units: F.Column, level: int, seed: int) -> F.Column:
    """The fold of ordered units: struct(open: the one still fractional or null, done: the rounded ones)."""
    put = lambda u, p: _unit(u["size"], u["key"], u["doc_id"], u["ordinal"], p, F.when(p >= 1, 1).when(p <= 0, 0).otherwise(F.lit(None).cast("int")))
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def step(acc: F.Column, b: F.Column) -> F.Column:
        a = acc["open"]
        pa, pb, sa, sb = a["p"], b["p"], a["size"].cast("double"), b["size"].cast("double")
        up, down = F.least((1 - pa) * sa, pb * sb), F.least(pa * sa, (1 - pb) * sb)  # words that can go to a, or from it
        to_a = _chance(a["key"], b["key"], level, seed) * (up + down) < down
        # ends are set exactly, not by arithmetic that could miss them
        new_a = F.when(to_a, F.when((1 - pa) * sa <= pb * sb, 1.0).otherwise(pa + up / sa)).otherwise(F.when(pa * sa <= (1 - pb) * sb, 0.0).otherwise(pa - down / sa))
        new_b = F.when(to_a, F.when(pb * sb <= (1 - pa) * sa, 0.0).otherwise(pb - up / sb)).otherwise(F.when((1 - pb) * sb <= pa * sa, 1.0).otherwise(pb + down / sb))
        # let binding: both values are computed once
        bound = F.transform(F.array(F.struct(new_a.alias("a"), new_b.alias("b"))), lambda x: F.struct(put(a, x["a"]).alias("a"), put(b, x["b"]).alias("b")))
        after = F.transform(
            bound,
            lambda x: F.struct(
                F.when(x["a"]["taken"].isNull(), x["a"]).when(x["b"]["taken"].isNull(), x["b"]).alias("open"),
                F.concat(acc["done"], F.filter(F.array(x["a"], x["b"]), lambda u: u["taken"].isNotNull())).alias("done"),
            ),
        )
        return F.when(a.isNull(), F.struct(b.alias("open"), acc["done"].alias("done"))).otherwise(F.get(after, 0))

    return F.aggregate(units, start, step)


def _round(units: DataFrame, seed: int) -> DataFrame:
    """doc_id, ordinal, taken (0 or 1) of units (source, size, key, doc_id, ordinal, p) with 0 < p < 1."""
    done, left, level = None, units, 0
    while True:
        per = materialise(left.groupBy(F.col("source").alias("its_source")).agg(F.count("*").alias("units")), "mixing-sources")  # written, so that Spark knows its size and broadcasts it where it is small
        dealt = left.join(per, F.col("source").eqNullSafe(F.col("its_source"))).select("source", "size", "key", "doc_id", "ordinal", "p", F.pmod(F.xxhash64("key", F.lit(level), F.lit(seed)), F.ceil(F.col("units") / BLOCK)).alias("block"))
        unit = F.struct((-F.col("size")).alias("order"), "key", _unit(F.col("size"), F.col("key"), F.col("doc_id"), F.col("ordinal"), F.col("p"), F.lit(None).cast("int")).alias("unit"))
        folded = dealt.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(unit)), lambda x: x["unit"]).alias("units")).select("source", _fold(F.col("units"), level, seed).alias("f"))
        folded = materialise(folded, f"mixing-{level}")
        rounded = folded.select(F.explode("f.done").alias("u")).select("u.doc_id", "u.ordinal", "u.taken")
        done = rounded if done is None else done.unionByName(rounded)
        left = folded.where("f.open is not null").select("source", "f.open.size", "f.open.key", "f.open.doc_id", "f.open.ordinal", "f.open.p")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            alone = left.select("doc_id", "ordinal", F.when(_chance(F.col("key"), F.lit(0), -1, seed) < F.col("p"), 1).otherwise(0).alias("taken"))
            return done.unionByName(alone)
        level += 1


def mix_plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, ordinal (among rows of that id), size, source_size, target, copies, taken of each row."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[source_column].alias("source"), words_of(docs[text_column]).alias("size"), F.xxhash64(docs[source_column], docs[text_column]).alias("same"))
    rows = rows.withColumn("ordinal", F.row_number().over(ordinal_window()).cast("long"))
    rows = materialise(rows, "mixing")
    by = materialise(targets(rows, weights, most).withColumnRenamed("source", "its_source"), "mixing-targets")
    joined = rows.join(by, F.col("source").eqNullSafe(F.col("its_source"))).select("doc_id", "ordinal", "source", "size", "source_size", "target", F.xxhash64("doc_id", "ordinal", "same").alias("key"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("expected", F.least(expected, F.lit(float(most)))).withColumns({"whole": F.floor("expected"), "p": F.col("expected") - F.floor("expected")})
    open_ = joined.where("size > 0 and p > 0")
    # long documents first: at most LONG of a source. What their rounding adds or lacks, the others make up for.
    long = F.col("size") * LONG > F.col("source_size")
    unit = ["source", "size", "key", "doc_id", "ordinal", "p"]
    first = materialise(_round(open_.where(long).select(unit), seed), "mixing-long")
    mine = open_.where(long).select("source", "size", "p", "doc_id", "ordinal").join(first.select(F.col("doc_id").alias("d"), F.col("ordinal").alias("o"), "taken"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("ordinal") == F.col("o")))
    excess = mine.groupBy(F.col("source").alias("its_source")).agg(F.sum((F.col("taken") - F.col("p")) * F.col("size")).alias("excess"), F.sum("size").alias("long_size"))
    excess = materialise(excess, "mixing-excess")
    rest = open_.where(~long).join(excess, F.col("source").eqNullSafe(F.col("its_source")), "left")
    shift = F.coalesce(F.col("excess") / (F.col("source_size") - F.col("long_size")), F.lit(0.0))
    rest = rest.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - shift)))
    settled = rest.where("p <= 0 or p >= 1").select("doc_id", "ordinal", F.col("p").cast("int").alias("taken"))
    rounded = first.unionByName(settled).unionByName(_round(rest.where("p > 0 and p < 1").select(unit), seed + 1))
    rounded = rounded.select(F.col("doc_id").alias("rounded_id"), F.col("ordinal").alias("rounded_ordinal"), F.col("taken").alias("rounded"))
    same = F.col("doc_id").eqNullSafe(F.col("rounded_id")) & (F.col("ordinal") == F.col("rounded_ordinal"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("rounded", F.lit(0))).otherwise(0).cast("long")
    return joined.join(rounded, same, "left").select("doc_id", "ordinal", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def ordinal_window() -> Window:
    return Window.partitionBy("doc_id").orderBy("same")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 0, **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay."""
    mine, nth, copies, row, copy = fresh(docs, "mix_id", "mix_ordinal", "mix_copies", "mix_row", "mix_copy")
    plan = mix_plan(docs, id_column, text_column, source_column, seed, **options).where("copies > 0").select(F.col("doc_id").alias(mine), F.col("ordinal").alias(nth), F.col("copies").alias(copies))
    same = Window.partitionBy(docs[id_column].cast("long")).orderBy(F.xxhash64(docs[source_column], docs[text_column]))
    numbered = docs.withColumn(row, F.row_number().over(same).cast("long"))
    taken = numbered.join(plan, numbered[id_column].cast("long").eqNullSafe(plan[mine]) & (numbered[row] == plan[nth]))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
