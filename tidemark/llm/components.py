"""Connected components by hooking to the smallest neighbour and pointer jumping.

Every step is a join or a map-side combined minimum, written to the shared folder, so no component and
no link list reaches the driver and a lost executor repeats one step only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: hook every node to its smallest neighbour (if smaller) and jump to the tree's root."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.col("u").alias("root")))
    up = ends.groupBy("node").agg(F.min("root").alias("root"))
    up = written(up.select("node", F.least("node", "root").alias("root")), "hooks")
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(up.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "jumps")
        up = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every end of ``edges`` (u, v)."""
    edges = edges.filter("u <> v")
    found: DataFrame | None = None
    while True:
        roots = _roots(edges)
        if found is None:
            found = roots
        else:
            higher = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = found.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        a = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = roots.select(F.col("node").alias("v"), F.col("root").alias("b"))
        between = edges.join(a, "u").join(b, "v").filter("a <> b")
        edges = written(between.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return written(found, "components")
