"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources in code-point order (null last) get ``weights`` in turn and share ``share`` of all
words; a target stops at ``most`` times its source's size and the excess is shared again by weight.
The fixpoint is found in closed form: with sources ordered by most*size/weight, the saturated ones are
a prefix of that order.

Curriculum: a source's demand rate over training time t in [0, 1] is its target times a piecewise
linear schedule, integrated to a piecewise quadratic curve.  A source's documents, in the order of a
hash of their id, form a stream of words that the mix reads once or twice, up to the target; the copy
that holds the last word is cut there.  A copy that begins at word c of the stream is trained on at
the t where the cumulative demand is c, which a quadratic equation gives.  Rows are range-sorted by
that position.

Prefix sums are taken in two levels (buckets of the hash, then rows of a bucket), so a source that
holds most rows is spread over all buckets.  Rows with equal id, size and source are interchangeable.
Null text has size 0, is never taken and has no position; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

WEIGHTS = (5, 2, 1)
#: For each weight in turn, (t, rate) knots of the schedule; rates are relative.
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.7, 0.5), (1.0, 3.0)))
#: Columns that the mix adds.
ADDED = {"size", "source_size", "target", "taken", "position", "position_again"}
HEX = 3  # leading hash digits that name a bucket: 4,096 buckets


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with kind (index into weights) and target.  One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("kind", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("wanted", F.least(share * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    s = s.withColumn("left", F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    #: the price at which this source and all later ones would share what is left
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("price", F.col("left") / F.col("heavy"))
    s = s.withColumn("price", F.min(F.when(F.col("price") <= F.col("level"), F.struct("rank", "price"))).over(everything).price)
    target = F.least(F.col("cap"), F.coalesce(F.col("price") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "kind", target.alias("target"))


def _time(schedule, u: Column) -> Column:
    """Inverse of the schedule's normalised integral at u in [0, 1]."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    total, out, done = sum(area), None, 0.0
    for (t0, v0), (t1, v1), x in zip(schedule, schedule[1:], area):
        need = u * total - done
        slope = (v1 - v0) / (t1 - t0)
        at = t0 + (need / v0 if slope == 0 else (F.sqrt(F.greatest(F.lit(v0 * v0) + 2 * slope * need, F.lit(0.0))) - v0) / slope)
        done += x
        out = F.when(u * total <= done, at) if out is None else out.when(u * total <= done, at)
    return F.least(F.greatest(F.coalesce(out.otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``carry`` columns (default doc_id, source, lang), size, source_size, target, taken,
    position and position_again (training time of the first and second copy; null if not taken).  Carried columns named as
    one of these are replaced.  Texts are read twice, for the sizes of buckets and for the rows, and not written in between."""
    carry = [c for c in docs.columns if c in ("doc_id", "source", "lang")] if carry is None else carry
    carry = [c for c in carry if c.lower() not in ADDED]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    rows = docs.select(own.alias("own"), F.col("doc_id").alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"))
    #: one column that is never null names source and bucket: window and join then share a shuffle of the rows
    place = lambda s, b: F.concat(F.coalesce(F.concat(F.lit("s"), F.col(s)), F.lit("n")), F.col(b))
    rows = rows.withColumn("bucket", F.substring("key", 1, HEX))
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = buckets.select("source", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    base = based.join(sources, based.source.eqNullSafe(sources.source)).select(
        based.source.alias("s"), F.col("bucket").alias("b"), "base", "source_size", "kind", "target").select(place("s", "b").alias("at"), "base", "source_size", "kind", "target")
    rows = rows.withColumn("place", place("source", "bucket")).drop("source", "bucket")
    inside = Window.partitionBy("place").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = rows.join(base, rows.place == base["at"])
    j = j.withColumn("first", F.col("base") + F.col("within")).withColumn("again", F.col("first") + F.col("source_size"))
    words = F.floor(F.col("target")).cast("long")
    part = lambda c: F.greatest(F.least(words - F.col(c), F.col("size")), F.lit(0).cast("long"))
    rounds = [part("first"), part("again")]

    def when(c: str, taken: Column) -> Column:
        u = F.col(c) / F.col("target")
        at = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            at = F.when(F.col("kind") % len(schedules) == k, _time(schedule, u)).otherwise(at)
        return F.when(taken > 0, at)

    return j.select(*[F.col(f"own.`{c}`").alias(c) for c in carry], "size", "source_size", "target", (rounds[0] + rounds[1]).alias("taken"),
                    when("first", rounds[0]).alias("position"), when("again", rounds[1]).alias("position_again"))


def training_order(mix: DataFrame) -> DataFrame:
    """The mix range-sorted by its first training position; untaken documents come last."""
    return mix.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
