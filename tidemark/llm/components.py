"""Connected components of a link table, on the executors.

Every node repeatedly takes the smallest label among its neighbours and then the label of its label
(pointer jumping), so paths shrink geometrically. Labels are written to the shared folder after each round,
which cuts lineage and lets the adaptive planner split a hub's partition, as both join sides are plain
exchanges. Minima are combined before the shuffle. Only a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Null ends and self-links are ignored; direction and repeats do not matter; no links give no rows.
    """
    one_way = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = one_way.select(F.col(a).alias("node"), F.col(b).alias("peer"))
    both = both.unionAll(both.select("peer", "node")).distinct()
    both = materialize(both, "links")
    labels = materialize(
        both.groupBy("node").agg(F.min("peer").alias("least")).select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        seen = both.join(labels.select(F.col("node").alias("peer"), F.col("component").alias("of_peer")), "peer")
        near = seen.groupBy("node").agg(F.min("of_peer").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        step = materialize(step, "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        fresh = materialize(
            step.join(jump, "next").select("node", F.least("next", "jump").alias("component"), F.col("component").alias("was")),
            "labels",
        )
        changed = fresh.where("component <> was").limit(1).count()
        drop(labels, step)
        labels = fresh
        if not changed:
            drop(both)
            return labels.select("node", "component")


def merge_links(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels (node, component) after more ``links``: only the graph of components is solved, not that of nodes.

    ``labels`` must give each component its smallest node, as ``components`` does; new nodes may come with ``links``.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    lifted = ends.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    joined = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    every = labels.unionAll(ends.select("a", "a")).unionAll(ends.select("b", "b"))
    every = every.groupBy("node").agg(F.min("component").alias("component"))
    return materialize(every.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels")
