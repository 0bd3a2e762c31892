"""Connected components of an edge table as a Spark job.

Large-star and small-star rounds (Kiveris et al., 2014): every node is hooked
to the smallest node it has seen until the edges form stars.  Each round is a
shuffle with map-side minima, is checkpointed to the shared folder, and the
driver sees one counter a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.session import write_and_reload


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node that has an edge to another node.

    ``root`` is the smallest node reachable.  Self loops, repeated edges, nulls
    and an empty table are allowed; they add no rows."""
    e = (edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi"))).distinct())
    e = write_and_reload(e, "cc")
    while True:
        # large star: link every larger neighbour to the smallest one around the node
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("n")).union(e.select(F.col("lo").alias("v"), F.col("hi").alias("n")))
        low = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (both.join(low, "v").where(F.col("n") > F.col("v"))
                 .select(F.col("m").alias("lo"), F.col("n").alias("hi")).where("lo < hi").distinct())
        # small star: link smaller neighbours and the node itself to the smallest
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .union(down.select(F.col("m").alias("lo"), "hi")).where("lo < hi").distinct())
        new = write_and_reload(small, "cc")
        # stars: no node is both a root and a leaf, and each leaf has one root
        leaves = new.groupBy("hi").agg(F.count("*").alias("k"))
        open_ends = new.select(F.col("lo").alias("hi")).distinct().join(leaves.select("hi"), "hi", "left_semi").limit(1).count()
        many = 0 if open_ends else leaves.where("k > 1").limit(1).count()
        e = new
        if not open_ends and not many:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
