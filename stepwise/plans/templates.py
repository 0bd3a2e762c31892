"""The twenty analyst templates (T1-T20) as parameterised DataFrame functions.

Conventions shared by all templates:

* ``fact`` carries the roles of :data:`FACT_ROLES` plus the counting columns
  (``points, minutes, goals, assists, bonus, yellow, red, saves, xg, price,
  selected, transfers_in, transfers_out``).
* Columns that the SQL original selected bare under ``GROUP BY entity`` (side,
  segment) take the value of the **latest** row: ``max_by(x, (epoch, step, fixture))``.
* Every ``ORDER BY`` ends in a key tie-break, and sort columns come from a
  whitelist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.scalars import all_of, in_list, per90, venue_label
from stepwise.operators.relational import last_n_steps

def _latest_key():
    return F.struct("epoch", "step", "fixture")


def _latest(c: str) -> Column:
    return F.max_by(c, _latest_key()).alias(c)


def _check(value: str, allowed: Sequence[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} not in {list(allowed)}")
    return value


def _apps() -> Column:
    return F.count_if(F.col("minutes") > 0).alias("apps")


# T1
def team_roster(fact: DataFrame, side: int, epoch: int, segments: Sequence[str] | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("side") == side, F.col("epoch") == epoch, in_list("segment", segments)]))
    return (f.groupBy("entity", "segment")
             .agg(F.sum("points").alias("points"), F.sum("minutes").alias("minutes"),
                  F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), _apps())
             .orderBy(F.col("points").desc(), "entity", "segment"))


# T2
def top_scorers(fact: DataFrame, epoch: int, n: int, segment: str | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("epoch") == epoch, (F.col("segment") == segment) if segment else None]))
    g = f.groupBy("entity").agg(F.sum("points").alias("points"), F.sum("goals").alias("goals"),
                                _latest("side"), _latest("segment"))
    return g.orderBy(F.col("points").desc(), "entity").limit(n)


# T3
def team_summary(fact: DataFrame, epoch: int, sort: str = "points") -> DataFrame:
    col = {"points": "points", "goals": "goals", "squad": "squad"}[_check(sort, ["points", "goals", "squad"])]
    g = (fact.where(F.col("epoch") == epoch).groupBy("side")
             .agg(F.count_distinct("entity").alias("squad"), F.sum("points").alias("points"),
                  F.sum("goals").alias("goals"), F.sum("assists").alias("assists")))
    return g.orderBy(F.col(col).desc(), "side")


# T4
def entity_career(fact: DataFrame, entity: int) -> DataFrame:
    return (fact.where(F.col("entity") == entity).groupBy("epoch")
                .agg(F.sum("points").alias("points"), F.sum("minutes").alias("minutes"),
                     F.sum("goals").alias("goals"), F.count(F.lit(1)).alias("rows"),
                     F.min_by("price", F.struct("step", "fixture")).alias("start_price"),
                     F.max_by("price", F.struct("step", "fixture")).alias("end_price"))
                .withColumn("price_change", F.col("end_price") - F.col("start_price")))


# T5
def step_results(fact: DataFrame, epoch: int, step: int, min_minutes: int = 0,
                 segments: Sequence[str] | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("step") == step,
                           F.col("minutes") >= min_minutes, in_list("segment", segments)]))
    return f.select("entity", "fixture", "segment", "side", "other_side", "minutes", "points",
                    venue_label(F.col("is_home"), short=True).alias("venue")).orderBy(F.col("points").desc(), "entity", "fixture")


# T6
def head_to_head(fact: DataFrame, a: int, b: int) -> DataFrame:
    both = fact.where(F.col("entity").isin(a, b))
    return (both.groupBy("epoch").pivot("entity", [a, b])
                .agg(F.sum("points"))
                .withColumnsRenamed({str(a): "points_a", str(b): "points_b"}))


# T7
def xg_leaders(fact: DataFrame, epoch: int, n: int, metric: str = "xg", per_90: bool = False,
               segment: str | None = None) -> DataFrame:
    m = _check(metric, ["xg", "goals", "assists"])
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("minutes") > 0, (F.col("segment") == segment) if segment else None]))
    g = f.groupBy("entity").agg(F.sum(m).alias("total"), F.sum("minutes").alias("minutes"), _latest("side"))
    val = per90(F.col("total"), F.col("minutes")) if per_90 else F.col("total").cast("double")
    return g.withColumn("value", val).orderBy(F.col("value").desc_nulls_last(), "entity").limit(n)


# T8
def price_movers(fact: DataFrame, epoch: int, n: int, direction: str = "both") -> DataFrame:
    _check(direction, ["risers", "fallers", "both"])
    o = F.struct("step", "fixture")
    g = (fact.where(F.col("epoch") == epoch).groupBy("entity")
             .agg(F.min_by("price", o).alias("start_price"), F.max_by("price", o).alias("end_price"))
             .withColumn("change", F.col("end_price") - F.col("start_price"))
             .where(F.col("change").isNotNull()))
    order = {"risers": [F.col("change").desc()], "fallers": [F.col("change").asc()],
             "both": [F.abs(F.col("change")).desc()]}[direction]
    return g.orderBy(*order, "entity").limit(n)


# T9
def reliable_starters(fact: DataFrame, epoch: int, min_apps: int, n: int, segment: str | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("minutes") > 0, (F.col("segment") == segment) if segment else None]))
    g = (f.groupBy("entity").agg(_apps(), F.sum("minutes").alias("minutes"), F.sum("points").alias("points"))
          .where(F.col("apps") >= min_apps)
          .withColumn("points_per_app", F.col("points") / F.nullif(F.col("apps"), F.lit(0))))
    return g.orderBy(F.col("minutes").desc(), "entity").limit(n)


# T10
def transfers(fact: DataFrame, epoch: int, step: int, metric: str, n: int, segment: str | None = None) -> DataFrame:
    m = _check(metric, ["transfers_in", "transfers_out", "selected"])
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("step") == step,
                           (F.col("segment") == segment) if segment else None]))
    return f.select("entity", "fixture", m).orderBy(F.col(m).desc(), "entity", "fixture").limit(n)


# T11
def defensive_record(fact: DataFrame, epoch: int, segment: str, min_minutes: int = 60) -> DataFrame:
    f = fact.where((F.col("epoch") == epoch) & (F.col("segment") == segment) & (F.col("minutes") >= min_minutes))
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    return (f.groupBy("side")
             .agg(F.count_distinct(F.when(ga == 0, F.col("fixture"))).alias("clean_sheets"),
                  F.count_distinct("fixture").alias("fixtures"))
             .withColumn("clean_sheet_pct",
                         F.lit(100.0) * F.col("clean_sheets") / F.nullif(F.col("fixtures"), F.lit(0)))
             .orderBy(F.col("clean_sheet_pct").desc_nulls_last(), "side"))


# T12
def bonus_leaders(fact: DataFrame, epoch: int, n: int, segment: str | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("minutes") > 0, (F.col("segment") == segment) if segment else None]))
    g = (f.groupBy("entity").agg(F.sum("bonus").alias("bonus"), F.sum("points").alias("points"), _latest("side"))
          .withColumn("bonus_pct", F.lit(100.0) * F.col("bonus") / F.nullif(F.col("points"), F.lit(0))))
    return g.orderBy(F.col("bonus").desc(), "entity").limit(n)


# T13
def haul_hunters(fact: DataFrame, threshold: int, n: int, epoch: int | None = None,
                 min_apps: int = 5) -> DataFrame:
    f = fact.where(F.col("epoch") == epoch) if epoch is not None else fact
    g = (f.groupBy("entity")
          .agg(F.count_if(F.col("points") >= threshold).alias("hauls"), _apps(),
               F.max("points").alias("best"), F.avg(F.when(F.col("minutes") > 0, F.col("points"))).alias("mean_points"), _latest("side"))
          .where(F.col("apps") >= min_apps)
          .withColumn("haul_rate", F.col("hauls") / F.nullif(F.col("apps"), F.lit(0))))
    return g.orderBy(F.col("hauls").desc(), F.col("mean_points").desc(), "entity").limit(n)


# T14
def current_form(fact: DataFrame, epoch: int, last_n: int, min_minutes: int, n: int) -> DataFrame:
    f = last_n_steps(fact.where(F.col("epoch") == epoch), "step", last_n).where(F.col("minutes") >= min_minutes)
    g = f.groupBy("entity").agg(F.sum("points").alias("form_points"), F.sum("minutes").alias("minutes"),
                                F.count(F.lit(1)).alias("rows"))
    return g.orderBy(F.col("form_points").desc(), "entity").limit(n)


# T15
def venue_splits(fact: DataFrame, entity: int, by_epoch: bool = False) -> DataFrame:
    f = fact.where((F.col("entity") == entity) & (F.col("minutes") > 0)).withColumn("venue", venue_label(F.col("is_home")))
    keys = ["epoch", "venue"] if by_epoch else ["venue"]
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("points").alias("mean_points"),
                                F.sum("goals").alias("goals"))


# T16
def attacking_returns(fact: DataFrame, epoch: int, sort: str, min_apps: int, n: int, segment: str | None = None, expected: bool = False) -> DataFrame:
    """Goals and assists of those with enough appearances; ``expected`` adds the expected goals and what exceeds them."""
    col = _check(sort, ["returns", "goals", "assists"])
    f = fact.where(all_of([F.col("epoch") == epoch, F.col("minutes") > 0, (F.col("segment") == segment) if segment else None]))
    g = (f.groupBy("entity").agg(F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), _apps(), *[F.sum("xg").alias("xg")] * expected)
          .withColumn("returns", F.col("goals") + F.col("assists"))
          .where(F.col("apps") >= min_apps))
    if expected:
        g = g.withColumn("goals_over_xg", F.col("goals") - F.col("xg"))
    return g.orderBy(F.col(col).desc(), "entity").limit(n)


# T17
def double_steps(fact: DataFrame, epoch: int, step: int | None = None, segment: str | None = None) -> DataFrame:
    f = fact.where(all_of([F.col("epoch") == epoch, (F.col("step") == step) if step is not None else None,
                           (F.col("segment") == segment) if segment else None]))
    return (f.groupBy("entity", "step")
             .agg(F.count_distinct("fixture").alias("fixtures"), F.sum("points").alias("points"),
                  F.sum("minutes").alias("minutes"), F.sum("goals").alias("goals"), F.sum("assists").alias("assists"),
                  F.round(F.max("price") / 10.0, 1).alias("price"), _latest("side"), _latest("segment"))
             .where(F.col("fixtures") > 1).orderBy(F.col("points").desc(), "entity", "step"))


def double_step_list(fact: DataFrame, epoch: int) -> DataFrame:
    """The steps of an epoch in which some entity has several fixtures."""
    return (fact.where(F.col("epoch") == epoch).groupBy("entity", "step")
                .agg(F.min("fixture").alias("_first"), F.max("fixture").alias("_last"))
                .where("_first < _last").select("step").distinct().orderBy("step"))


# T18
def keeper_stats(fact: DataFrame, epoch: int, segment: str, sort: str, min_apps: int, n: int, min_minutes: int = 60) -> DataFrame:
    col = _check(sort, ["saves", "save_points", "saves_per_90"])
    f = fact.where((F.col("epoch") == epoch) & (F.col("segment") == segment) & (F.col("minutes") >= min_minutes))
    g = (f.groupBy("entity").agg(F.sum("saves").alias("saves"), F.sum("minutes").alias("minutes"), _apps())
             .where(F.col("apps") >= min_apps)
             .withColumn("save_points", F.round(F.col("saves") / 3).cast("bigint"))
             .withColumn("saves_per_90", per90(F.col("saves"), F.col("minutes"))))
    return g.orderBy(F.col(col).desc_nulls_last(), "entity").limit(n)


# T19
def suspension_risk(fact: DataFrame, epoch: int, n: int, limit_yellow: int = 5) -> DataFrame:
    g = (fact.where((F.col("epoch") == epoch) & (F.col("minutes") > 0)).groupBy("entity")
             .agg(F.sum("yellow").alias("yellow"), F.sum("red").alias("red"), _apps())
             .withColumn("cards_per_app", (F.col("yellow") + F.col("red")) / F.nullif(F.col("apps"), F.lit(0)))
             .withColumn("at_risk", F.col("yellow") >= limit_yellow))
    return g.orderBy(F.col("yellow").desc(), F.col("red").desc(), "entity").limit(n)


# T20
def epoch_history(fact: DataFrame) -> DataFrame:
    """One row per entity and epoch: totals, first and last price."""
    o = F.struct("step", "fixture")
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    return (fact.groupBy("entity", "epoch")
                .agg(*[F.sum(c).alias(c) for c in ("points", "minutes", "goals", "assists")],
                     F.count_if(ga == 0).alias("clean_sheets"), F.sum("saves").alias("saves"), F.sum("bonus").alias("bonus"),
                     F.min_by("price", o).alias("start_cost"), F.max_by("price", o).alias("end_cost")))


def season_history(history: DataFrame, epochs: DataFrame, entity: int) -> DataFrame:
    """An entity's history with the labels of the epoch dimension (``epoch, label``)."""
    def tenths(c: Column) -> Column:
        return F.round(c / 10.0, 1)

    return (history.where(F.col("entity") == entity).join(epochs.select("epoch", "label"), "epoch")
                   .select("epoch", F.col("label").alias("season"), "points", "minutes", "goals", "assists", "clean_sheets", "saves", "bonus",
                           tenths(F.col("start_cost")).alias("start_price"), tenths(F.col("end_cost")).alias("end_price"),
                           tenths(F.col("end_cost") - F.col("start_cost")).alias("price_change"))
                   .orderBy("epoch"))
