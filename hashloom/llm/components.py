"""Connected components of an edge table by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table

SALTS = 256


def _renamed(edges: DataFrame, end: str, other: str, point: DataFrame) -> DataFrame:
    """edges with `end` replaced by what point(u, p) has for it. A hub's edges are dealt by salts of the other end, each with a copy of the hub's row; a node with few edges has no more copies than edges."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    copies = salted.select(end, "salt").distinct().join(point.select(F.col("u").alias(end), "p"), end)
    return salted.join(copies, [end, "salt"]).select(F.col("p").alias(end), other)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge (a, b); label is the same for connected nodes and differs else.

    Each round points every node at the least of itself and its neighbours (a partial aggregate, so a hub costs a row a task), renames both
    ends of all edges and drops those that have become loops; stars fall in one or two rounds, paths in about log2 of
    their length. Rounds are written to the shared folder. Edges with a null end and loops count for nothing. No edges: no rows."""
    e, labels = edges.select("a", "b").where("a <> b"), None
    while labels is None or not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("u", "v")
        point = persist_table(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "cc-points")
        moved = _renamed(_renamed(e, "a", "b", point), "b", "a", point).where("a <> b")
        e = persist_table(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = point.toDF("node", "label")
        else:
            labels = labels.join(point.toDF("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return persist_table(labels, "cc-labels")
