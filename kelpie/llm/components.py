"""Connected components by contraction: every node points at its smallest neighbour, pointers jump, edges shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); a component is named by its smallest node.

    Edges, labels and pointers stay in tables; a hub's edges meet copies of its pointer. Star-shaped input ends after one round, chains after about log rounds.
    """
    spark = edges.sparkSession
    node = edges.schema["a"].dataType.simpleString()
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = written(spread_join(parent, up, ["p"]).select(F.col("a").alias("node"), F.col("pp").alias("component")), "pointers")
        rounds.append(jumped)
        to_a = jumped.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        to_b = jumped.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        left = written(
            spread_join(spread_join(left, to_a, ["a"]), to_b, ["b"], left).filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(),
            "edges",
        )
    if not rounds:
        return spark.sql(f"SELECT CAST(NULL AS {node}) AS node, CAST(NULL AS {node}) AS component WHERE false")
    labels = rounds[0]
    for nxt in rounds[1:]:
        nxt = nxt.select(F.col("node").alias("component"), F.col("component").alias("nxt"))
        labels = labels.join(nxt, "component", "left").select("node", F.coalesce("nxt", "component").alias("component"))
    return written(labels, "labels") if len(rounds) > 1 else labels
