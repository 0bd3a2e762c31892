"""Lag-safe window features that stay exact when one group is huge.

``Window.partitionBy(entity, epoch)`` puts a whole group in one task.  That is
fine while groups are bounded (steps per epoch), but if one key holds a third
of all rows the job degenerates to one task.  :func:`lagged_features` splits
such hot groups:

1. group sizes come from one aggregate; groups above ``hot_rows`` are hot
   (at most ``rows / hot_rows`` of them -- that bound makes the hot-key table
   safe to broadcast);
2. hot rows are range-partitioned on ``(group, step, seq)`` -- Spark samples
   the composite key, so one group spans many balanced partitions -- and each
   row's global position in its group is the prefix count of earlier
   partitions plus its rank inside the partition;
3. rows are re-cut into fixed blocks of ``block`` positions; the last
   ``max(k)`` rows of a block are copied into the next block as a halo, the
   usual window runs per block, and halo rows are dropped;
4. to-date means come from exact prefix sums (partition offsets + in-block
   running sums).

Normal groups take the plain window path; both results are unioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.scalars import min_group_size
from stepwise.operators import windows as W
from stepwise.roles import Roles
from stepwise.session import cut_lineage

UNB = Window.unboundedPreceding


def _plain(df: DataFrame, r: Roles, roll, ks, todate, lags) -> DataFrame:
    out = W.lagged_rolling_mean(df, r, roll, ks)
    out = W.lagged_expanding_mean(out, r, todate)
    return W.lag_features(out, r, lags)


def lagged_features(df: DataFrame, r: Roles, roll: Sequence[str], ks: Sequence[int] = (3, 5),
                    todate: Sequence[str] = (), lags: Sequence[str] = (), hot_rows: int = 5_000_000,
                    partitions: int | None = None, block: int = 1_000_000, min_rows: int = 1) -> DataFrame:
    """WIN1 + WIN2 + WIN3 with hot groups split (see module docstring); groups of fewer
    than ``min_rows`` rows go (FLT2).  Without hot groups the rows are counted over the
    partition that the features need anyway, so they are exchanged and sorted once."""
    g = r.group
    halo = max([*ks, 1])
    if block <= halo:
        raise ValueError("block must exceed the largest window")
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_gn"))
    hot = sizes.where(F.col("_gn") > hot_rows).select(*g)
    # Decide at runtime: one aggregate pass finds the hot keys; with none,
    # the plain single-sort window plan is used unchanged.
    if hot.isEmpty():
        if min_rows > 1:
            known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in g])   # a null key is in no group
            df = df.where(known).withColumn("_gn", F.count(F.lit(1)).over(Window.partitionBy(*g)))
        out = _plain(df, r, roll, ks, todate, lags)
        return out.where(F.col("_gn") >= min_rows).drop("_gn") if min_rows > 1 else out
    if min_rows > 1:
        df = min_group_size(df, g, min_rows)
    # bound: at most (total rows / hot_rows) keys
    hot_b = F.broadcast(hot)
    normal = _plain(df.join(hot_b, g, "left_anti"), r, roll, ks, todate, lags)
    hot_rows_df = df.join(hot_b, g, "left_semi")

    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*g, *r.order]
    # 2. balanced contiguous ranges; the range id is frozen by a checkpoint
    ranged = cut_lineage(hot_rows_df.repartitionByRange(n_parts, *order)
                         .withColumn("_chunk", F.spark_partition_id()))
    wl = Window.partitionBy(*g, "_chunk").orderBy(*r.order)
    local = ranged.withColumn("_li", F.row_number().over(wl) - 1)
    for c in todate:
        local = local.withColumn(f"_cs_{c}", F.coalesce(F.sum(c).over(wl.rowsBetween(UNB, -1)), F.lit(0.0)))
        local = local.withColumn(f"_cn_{c}", F.count(c).over(wl.rowsBetween(UNB, -1)))
    chunk_stats = ranged.groupBy(*g, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_s_{c}") for c in todate],
        *[F.count(c).alias(f"_k_{c}") for c in todate])
    wc = Window.partitionBy(*g).orderBy("_chunk").rowsBetween(UNB, -1)   # <= n_parts rows per group
    offs = chunk_stats.select(
        *g, "_chunk", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_s_{c}").over(wc), F.lit(0.0)).alias(f"_os_{c}") for c in todate],
        *[F.coalesce(F.sum(f"_k_{c}").over(wc), F.lit(0)).alias(f"_ok_{c}") for c in todate])
    pos = local.join(F.broadcast(offs), [*g, "_chunk"]).withColumn("_idx", F.col("_off") + F.col("_li"))
    # 4. to-date mean from exact prefix sums
    pos = pos.withColumns({
        f"{c}_todate": (F.col(f"_os_{c}") + F.col(f"_cs_{c}"))
        / F.nullif(F.col(f"_ok_{c}") + F.col(f"_cn_{c}"), F.lit(0)) for c in todate})
    # 3. fixed blocks with a halo of the previous `halo` rows
    b = (F.col("_idx") / block).cast("bigint")
    tail = (F.col("_idx") % block) >= (block - halo)
    pos = pos.withColumn("_blocks", F.when(tail, F.array(F.struct(b.alias("blk"), F.lit(False).alias("is_halo")),
                                                         F.struct((b + 1).alias("blk"), F.lit(True).alias("is_halo"))))
                                      .otherwise(F.array(F.struct(b.alias("blk"), F.lit(False).alias("is_halo")))))
    ex = pos.withColumn("_b", F.explode("_blocks")).select("*", "_b.blk", "_b.is_halo")
    wb = Window.partitionBy(*g, "blk").orderBy("_idx")
    ex = ex.withColumns({f"{c}_roll{k}": F.avg(c).over(wb.rowsBetween(-k, -1)) for c in roll for k in ks})
    ex = ex.withColumns({f"{c}_lag1": F.lag(c, 1).over(wb) for c in lags})
    hot_out = ex.where(~F.col("is_halo")).select(*normal.columns)
    return normal.unionByName(hot_out)
