"""Star-schema loaders (LD1-LD6) over raw extracts already read as
DataFrames (see :mod:`stepwise.sources.files`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.scalars import bool_to_int, coerce_numeric, col_or_default, count_stat, derived_with_override, null_unless
from stepwise.operators.aggregates import keep_latest, mode_smallest
from stepwise.operators.relational import bridge_join, keep_known, own_side_from_other


# LD2
def dim_entity(raw: DataFrame, entity: str, order_desc: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Latest attributes per entity (newest row by ``order_desc``, first of
    which is the epoch; the code wins over the 'first non-null' design note)
    plus the debut epoch."""
    latest = keep_latest(raw.select(entity, *order_desc, *attrs), [entity], order_desc)
    debut = raw.groupBy(entity).agg(F.min(order_desc[0]).alias("debut_epoch"))
    return latest.drop(*order_desc).join(debut, entity)


# LD3
def dim_side(listed: DataFrame | None, observed: DataFrame, epoch: str, side: str, name: str) -> DataFrame:
    """Side names: the list file where it exists, else the most frequent name
    observed for the side in that epoch (ties -> smallest)."""
    derived = mode_smallest(observed, [epoch, side], name, name)
    if listed is None:
        out = derived
    else:
        out = listed.select(epoch, side, name).unionByName(
            derived.join(listed.select(epoch).distinct(), epoch, "left_anti"))
    from pyspark.sql import Window
    return out.withColumn("side_sk", F.row_number().over(Window.orderBy(epoch, side)).cast("bigint"))


# LD4
def dim_entity_epoch(raw: DataFrame, sides: DataFrame, epoch: str, entity: str, local_side: str, now_cost: str, change: str,
                     costs: DataFrame | None = None, stats: Sequence[str] = ()) -> DataFrame:
    """A row per entity and epoch: the side's key by (epoch, local side), start and end cost, season totals.

    The start cost is the history's where it has one that is not 0, else current cost
    less change; the end cost is the history's.  ``stats`` that an era's extract does
    not have are null.  A side that is not known leaves a null key, the row stays."""
    d = raw.select(F.col(epoch).alias("epoch"), F.col(entity).alias("entity"), F.col(local_side).alias("side"),
                   coerce_numeric(now_cost, "bigint").alias("_now"), coerce_numeric(change, "bigint").alias("_change"),
                   *[coerce_numeric(col_or_default(raw, c), "double").alias(c) for c in stats])
    d = d.join(sides.select("epoch", "side", "side_sk"), ["epoch", "side"], "left")
    if costs is None:
        d = d.withColumns({"_start": F.lit(None).cast("bigint"), "end_cost": F.lit(None).cast("bigint")})
    else:
        d = d.join(costs.select("entity", "epoch", F.col("start_cost").alias("_start"), "end_cost"), ["entity", "epoch"], "left")
    return d.select("epoch", "entity", "side_sk", derived_with_override(F.col("_start"), F.col("_now"), F.col("_change")).alias("start_cost"), "end_cost", *stats)


# LD5
def history(copies: DataFrame, entity: str, epoch: str, source: str, known: DataFrame) -> DataFrame:
    """Overlapping history copies: keep the newest source per (entity, epoch)
    (path as deterministic tie-break), then only known entities."""
    latest = keep_latest(copies, [entity, epoch], [source], [F.col("source_file")])
    return keep_known(latest, known, [entity])


def cost_index(latest: DataFrame, entity: str, epoch_name: str, epochs: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (entity, epoch, start_cost, end_cost) of a deduplicated history: names such as
    ``2021/22`` become epochs by the table (name, epoch); rows of other names or without an entity go."""
    named = latest.where(F.col(entity).isNotNull()).join(epochs.select(F.col("name").alias(epoch_name), F.col("epoch").alias("_epoch")), epoch_name)
    return named.select(F.col(entity).alias("entity"), F.col("_epoch").alias("epoch"), coerce_numeric(start, "bigint").alias("start_cost"),
                        coerce_numeric(end, "bigint").alias("end_cost"))


# LD6
def fact_rows(raw: DataFrame, bridge: DataFrame, local_id: str, entity: str, counts: Sequence[str],
              manager_cols: Sequence[str], keys: Sequence[str], is_home: str = "was_home",
              opponent: str = "opponent_team", match: Sequence[str] = ("epoch", "step", "fixture"),
              ) -> tuple[DataFrame, DataFrame]:
    """Local id -> stable key (unmatched counted and dropped), home flag
    normalised **before** it is used, own side derived from the opponents,
    counting stats coerced (null -> 0), manager columns nulled unless
    win + draw + loss = 1, and an exact-key dedupe."""
    d = raw.withColumn(is_home, bool_to_int(is_home))
    d, obs = bridge_join(d, bridge, [local_id], entity)
    d = own_side_from_other(d, list(match), is_home, opponent, "side")
    d = d.withColumns({c: count_stat(c) for c in counts if c in d.columns})
    if manager_cols:
        present = [c for c in manager_cols if c in d.columns]
        wdl = sum((F.coalesce(coerce_numeric(c, "bigint"), F.lit(0)) for c in present
                   if c.endswith(("win", "draw", "loss"))), F.lit(0))
        d = null_unless(d, wdl == 1, present)
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in d.columns if c not in keys])   # full order
    d = d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return d, obs
