"""Mixing sources to target weights by capped water-filling.

``targets`` gives each source its share of the whole by weight, clamps it at
``max_epochs`` times its own size and hands the excess to the others in
proportion to their weights until none is above its clamp. In closed form: with
the sources in the order of clamp / weight, a source is clamped exactly if its
clamp is at most its share of what the sources before it left.

``mix`` repeats each document ``floor(target / size)`` times as a whole and
samples the fractional repetition: within a source, documents come in the order
of a seeded hash, and those before the point at which the fraction is used up
are taken once more, the one on that point in part. The point is found
by two histograms of 1,024 bins (the second within the bin of the first that
holds it) and the classes of equal (hash, id, size) in the last bin, so no source
is ever sorted in one task, nor rows that repeat an id or have none. How often a
document is taken then follows from its hash: documents are read once more, and
joined with one row for each source.

Defined cases: null texts have size 0; a null source is a source of its own,
last in order; sources of size 0 have target 0; an empty table gives an empty
result; rows that repeat a doc_id are separate documents (equal rows are
interchangeable); very long texts are sizes like any others; other columns are
passed through, whatever their names, but for ones with the names of the
results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, packed, small_or_plain

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
BINS = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    One row per source: a dimension, not a corpus, so its ordering may be one
    task's work.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    some = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(some, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    rows = rows.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = W.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("left", F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0)))
    rows = rows.withColumn("share", F.col("left") * F.col("weight") / F.sum("weight").over(rest))
    # once a source isn't clamped, none after it is; all those share one level
    rows = rows.withColumn("free", F.max((F.col("share") < F.col("clamp")).cast("int")).over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    level = F.min(F.when(F.col("free") == 1, F.struct(F.col("clamp") / F.col("weight"), F.col("source").isNull(), "source", (F.col("share") / F.col("weight")).alias("level")))).over(W.partitionBy())
    target = F.when(F.col("free") == 1, F.least(level["level"] * F.col("weight"), F.col("clamp"))).otherwise(F.col("clamp"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _join_on_source(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of documents with one row per source (or less): a broadcast
    where the counted rows are few, else a join whose hot keys are salted."""
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in plan.columns])
    plan, small = small_or_plain(plan)
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(plan[f"plan_{k}"])
    if not small:
        salts = 64
        rows = rows.withColumn("salt", F.pmod(F.col("mix_hash"), F.lit(salts)).cast("int"))
        plan = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = on & (F.col("salt") == F.col("plan_salt"))
    joined = rows.join(plan, on, "left")
    return joined.drop(*[f"plan_{k}" for k in keys], "salt", "plan_salt")


def mix_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of a seeded hash that any SQL engine can compute."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, their number from 0 within their source: numbers
    within each task, and totals of the tasks before, so that no task takes all."""
    rows = materialize(rows.withColumn("task", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id()))
    per = rows.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("src"), F.col("task").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    per, _ = small_or_plain(materialize(per))
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("src")) & (F.col("task") == F.col("of")))
    nth = F.col("before") + F.row_number().over(W.partitionBy("source", "task").orderBy("own")) - 1
    return joined.withColumn("nth", nth).drop("src", "of", "before", "task", "own")


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, ...) -> the same rows with source_size, target,
    copies (whole repetitions, long), part (words of the one partial
    repetition of its source, else 0) and taken = copies * size + part."""
    sizes, rest = packed(sizes.drop("source_size", "target", "copies", "part", "taken"), "doc_id", "source", "size")
    documents = sizes.withColumn("mix_hash", mix_hash(F.col("doc_id"), seed))
    # the plan is made from a few numbers of each document; its other columns are read once, at the end
    rows = materialize(documents.drop("__rest"))
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = targets(per, weights, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("want", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")))

    # the bin, of 2^10 and then of 2^20, in which each source's want is used up
    base = plan.select("source", "want", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("below"))
    bits = 60
    for shift in (50, 40):
        shown = rows.withColumn("bin", F.shiftright("mix_hash", bits)).withColumn("next", F.shiftright("mix_hash", shift))
        if bits == 60:
            counted = shown.groupBy("source", "bin", "next").agg(F.sum("size").alias("n"))
        else:
            counted = _join_on_source(shown, base.select("source", "bin"), ["source"]).where(F.col("bin") == F.col("plan_bin"))
            counted = counted.groupBy("source", "bin", "next").agg(F.sum("size").alias("n"))
        inner = W.partitionBy("source").orderBy("next")
        counted = counted.withColumn("upto", F.sum("n").over(inner))
        counted = counted.join(base.withColumnRenamed("source", "src").select("src", "want", "below"), F.col("source").eqNullSafe(F.col("src")))
        found = counted.where(F.col("below") + F.col("upto") > F.col("want"))
        found = found.groupBy("source").agg(F.min(F.struct("next", (F.col("below") + F.col("upto") - F.col("n")).alias("below"))).alias("f"))
        found = found.select(F.col("source").alias("src"), F.col("f.next").alias("bin"), F.col("f.below").alias("below"))
        # a source whose fraction is everything it has lies wholly below
        base = base.select("source", "want").join(found, F.col("source").eqNullSafe(F.col("src")), "left")
        base = base.select("source", "want", F.coalesce("bin", F.lit(1 << (60 - shift))).alias("bin"), F.coalesce("below", F.lit(0)).cast("long").alias("below"))
        base = materialize(base)
        bits = shift
    # rows of that bin in classes of equal (hash, id, size): in one of them the want is used up
    near = _join_on_source(rows, base, ["source"]).where(F.shiftright("mix_hash", bits) == F.col("plan_bin"))
    classes = near.groupBy("source", "mix_hash", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("plan_want").alias("want"), F.first("plan_below").alias("below"))
    upto = F.col("below") + F.sum(F.col("size") * F.col("n")).over(W.partitionBy("source").orderBy("mix_hash", "doc_id", "size"))
    on_point = classes.withColumn("upto", upto).where("upto > want").withColumn("left", F.col("want") - F.col("upto") + F.col("size") * F.col("n"))
    on_point = on_point.groupBy(F.col("source").alias("src")).agg(F.min(F.struct("mix_hash", "doc_id", "size", "n", "left")).alias("at"))
    plan = plan.join(on_point, F.col("source").eqNullSafe(F.col("src")), "left").select("source", "source_size", "target", "whole", "at")
    plan = materialize(plan)

    shown = _join_on_source(documents if rest else rows, plan, ["source"])
    at = F.col("plan_at")
    first_id = (F.col("doc_id").isNull() & at["doc_id"].isNotNull()) | F.coalesce(F.col("doc_id") < at["doc_id"], F.lit(False))
    place = F.when(at.isNull() | (F.col("mix_hash") < at["mix_hash"]), -1).when(F.col("mix_hash") > at["mix_hash"], 1)
    place = place.when(~F.col("doc_id").eqNullSafe(at["doc_id"]), F.when(first_id, -1).otherwise(1))
    shown = shown.withColumn("place", place.when(F.col("size") < at["size"], -1).when(F.col("size") > at["size"], 1).otherwise(0))
    part = F.when(F.col("place") < 0, F.col("size")).when(F.col("place") > 0, F.lit(0)).otherwise(at["left"])
    several = (F.col("place") == 0) & (at["n"] > 1)
    if plan.where("at.n > 1").isEmpty():
        done = shown.withColumn("part", part.cast("long"))
    else:
        done = shown.where(~F.coalesce(several, F.lit(False))).withColumn("part", part.cast("long"))
        nth = _numbered(shown.where(several))
        spent = F.greatest(F.lit(0), F.least(F.col("size"), at["left"] - F.col("nth") * F.col("size")))
        done = done.unionByName(nth.withColumn("part", spent.cast("long")).drop("nth"))
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    done = done.withColumn("copies", F.col("plan_whole") + full.cast("long")).withColumn("part", F.when(full, F.lit(0)).otherwise(F.col("part")).cast("long"))
    done = done.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    made = [F.col("plan_source_size").alias("source_size"), F.col("plan_target").alias("target"), "copies", "part", "taken"]
    return done.select("doc_id", "source", "size", *rest, *made)
