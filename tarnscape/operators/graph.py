"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.session import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected links.

    Each round hooks every component onto the smallest component that one of its links
    reaches, then follows the new pointers twice, so long chains halve in each round.
    Link and label tables stay distributed; only a count ends the loop. Nodes without links
    are absent. Null ends are ignored; repeated links and loops do no harm."""
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.union(both.select("v", "u")).distinct(), "links")
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    for _ in range(max_rounds):
        far = labels.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        hooks = (
            both.join(far, "v").join(labels, "u").where("cv < c")
            .groupBy("c").agg(F.min("cv").alias("to"))
        )
        hooks = cut(hooks, "hooks")
        if hooks.isEmpty():
            drop(hooks)
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
        onward = hooks.select(F.col("c").alias("to"), F.col("to").alias("to2"))
        jumped = hooks.join(onward, "to", "left").select("c", F.coalesce("to2", "to").alias("to"))
        fresh = cut(labels.join(jumped, "c", "left").select("u", F.coalesce("to", "c").alias("c")), "labels")
        drop(labels)
        drop(hooks)
        labels = fresh
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
