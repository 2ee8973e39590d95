"""Chat formatting after collapsing cumulative snapshots.

A logged conversation is often a snapshot of a longer one: its turns are the
first turns of the other. Each turn gets a rolling hash of the conversation up
to it; the hashes of all proper prefixes form a table of distinct keys, and an
anti-join drops conversations whose whole hash is among them. Of equal
conversations the one with the smallest id stays. What is left is rendered with
a turn template. Built-in functions only.

The rolling hash combines, by exclusive or, two 64-bit hashes of each turn's
position, role and text, so it is a running aggregate.

Defined cases: turns are ordered by turn (null first), role and text; exact
repeats of a turn count once; a null text is empty and a null role is
"unknown"; rows without conv_id make up one conversation of their own; an empty
table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Before the role, between role and text, and after the text of a turn.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position from 1 on, and the rolling hashes of
    the conversation up to them."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("position", F.row_number().over(order))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    for k in (1, 2):
        own = F.xxhash64(F.lit(k), "position", "role", "text", F.xxhash64("text", F.lit(k), "position"))
        turns = turns.withColumn(f"h{k}", F.bit_xor(own).over(so_far))
    return turns


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same) of the conversations that prefix no longer
    one; n_same counts the equal ones that each stands for."""
    last = W.partitionBy("conv_id").orderBy("position")
    marked = turns.select("conv_id", "position", "h1", "h2", F.lead("position").over(last).isNull().alias("whole"))
    whole = marked.where("whole").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_same"))
    proper = marked.where("not whole").select("position", "h1", "h2").distinct()
    kept = whole.join(proper, ["position", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("position").cast("long").alias("n_turns"), "n_same")


def render(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_same, text) of each maximal conversation."""
    turns = materialize(turns_of(conversations))
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    before, between, after = (F.lit(x) for x in template)
    said = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    said = said.groupBy("conv_id", "n_turns", "n_same").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(before, "role", between, "text", after).alias("line")))).alias("lines"))
    return said.select("conv_id", "n_turns", "n_same", F.array_join("lines.line", "").alias("text"))
