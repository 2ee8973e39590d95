"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_salted, materialize, small_or_plain


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): for every node of a link, the root of its
    component.

    Each round hooks every node onto its smallest neighbour (or itself),
    shortens the chains by pointer jumping, and contracts the links; at least
    half of the nodes that still have links disappear, so the number of rounds
    is logarithmic. Joins on roots, which may have very many nodes, are salted.
    Nothing but row counts reaches the driver.
    """
    left = materialize(links.select("a", "b").where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooked = up = materialize(up)
        small = small_or_plain(up)[1]  # as all that follows has as many rows or fewer
        for _ in range(2):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            up = join_salted(up, over, ["root"], "node", small=small).select("node", F.col("top").alias("root"))
        up = materialize(up)
        rounds.append(up)
        before = left
        for end, other in (("a", "b"), ("b", "a")):
            left = join_salted(left, up.withColumnRenamed("node", end), [end], other, small=small).drop(end).withColumnRenamed("root", end)
        left = materialize(left.select("a", "b").where("a <> b").distinct())
        discard(before, hooked)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for up in rounds[1:]:
        step = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = join_salted(out, step, ["root"], "node", "left").select("node", F.coalesce("top", "root").alias("root"))
    if len(rounds) == 1:
        return out
    out = materialize(out)
    discard(left, *rounds)
    return out
