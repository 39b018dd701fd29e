"""Connected components by rounds of contraction; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """id, component (smallest id reachable) for every id on an edge (u, v); ids are long.

    Each round every node joins its neighbour of the lowest hashed priority, drawn anew, and edges are renamed:
    nodes fall by a constant factor a round whatever the shape, so chains take as few rounds as stars. Each
    round's map is a table; labels are composed from the tables at the end.
    """
    edges = scratch.write(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps = []
    for r in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(r)), c)  # noqa: B023, E731
        low = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("low"))
        to = F.when(F.col("low") < rank(F.col("u")), F.col("low.v")).otherwise(F.col("u"))
        maps.append(scratch.write(low.select(F.col("u").alias("id"), to.alias("to")), "map"))
        a, b = (maps[-1].select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "uv")
        renamed = edges.join(a, "u").join(b, "v").filter("to_u <> to_v")
        left = scratch.write(renamed.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "edges")
        scratch.drop(edges)
        edges = left
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    label = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("id").alias("to"), F.col("to").alias("next"))
        label = label.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    label = scratch.write(label, "label")
    least = label.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component"))
    out = scratch.write(label.join(least, "to").select("id", "component"), "components")
    scratch.drop(edges, label, *maps)
    return out
