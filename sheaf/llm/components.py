"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ensure_checkpoint_dir


def _stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a written table in the shared checkpoint folder.

    A checkpoint hands on what the joins before it imply (constraints, equivalent partitionings); every round of
    joins multiplies that until planning takes minutes. A table read anew knows nothing of it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(a, b, df: DataFrame) -> DataFrame:
    return df.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows hooks to their end (the steps
    double or more each time), and replaces both ends of every edge by where they lead; loops
    and repeats go. Each round at least halves the nodes, and a star is done in one round. A hub costs only partial
    aggregation (``min``) and equi-joins that Spark can split. Round results are
    written tables. Nulls and self-links are ignored; an empty table gives no rows.
    """
    cur = _stored(_edges(F.col("_a"), F.col("_b"), edges.select(F.col(u).cast("long").alias("_a"), F.col(v).cast("long").alias("_b"))))
    label: DataFrame | None = None
    while not cur.isEmpty():
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = _stored(both.groupBy("u").agg(F.min("v").alias("_m"))
                           .select(F.col("u").alias("n"), F.least("u", "_m").alias("p")))
        moved = True
        while moved:
            up = hook.select(F.col("n").alias("_at"), F.col("p").alias("_p2"))
            two = hook.join(up, hook["p"] == up["_at"]).select("n", "p", "_p2")
            up = up.select(F.col("_at").alias("_at2"), F.col("_p2").alias("_p3"))
            three = _stored(two.join(up, two["_p2"] == up["_at2"]).select("n", "p", "_p3"))
            moved = not three.where("p <> _p3").isEmpty()
            hook = three.select("n", F.col("_p3").alias("p"))
        if label is None:
            label = hook.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            label = label.join(hook, label["component"] == hook["n"], "left").select(
                "node", F.coalesce("p", "component").alias("component"))
        label = _stored(label)
        left, right = hook.select(F.col("n").alias("u"), F.col("p").alias("_a")), \
            hook.select(F.col("n").alias("v"), F.col("p").alias("_b"))
        cur = _stored(_edges(F.col("_a"), F.col("_b"), cur.join(left, "u").join(right, "v")))
    if label is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label
