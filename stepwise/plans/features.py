"""Lag-safe feature builds (PL1 and the event feature block)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import windows as W
from stepwise.plans.bindings import EVENT_ROLES


def event_features(ev: DataFrame, ks=(3, 5)) -> DataFrame:
    """WIN1 + WIN2 + WIN3 on one shared window spec (one sort per group)."""
    r = EVENT_ROLES
    base = ev.select(*r.group, *r.order, "segment", "target")
    out = W.lagged_rolling_mean(base, r, ["target"], ks)
    out = W.lagged_expanding_mean(out, r, ["target"])
    out = W.lag_features(out, r, ["target"])
    return out.withColumn("is_purchase", (F.col("segment") == "purchase").cast("int"))


# ------------------------------------------------------------------ PL1
PLAYER_ROLL = ("points", "minutes", "goals", "xg", "assists", "bonus", "saves")
TODATE = ("points", "minutes")
LAGS = ("points", "price")
CONTEXT = ("epoch", "step", "fixture", "entity", "segment", "side", "other_side", "is_home")


def team_step_frame(fact: DataFrame) -> DataFrame:
    """Side x step frame: goals for/against summed over the side's fixtures.

    Many entity rows repeat one fixture's score, so rows are first collapsed
    to one per ``(epoch, side, fixture)`` by MIN (AGG12)."""
    gf = F.when(F.col("is_home") == 1, F.col("home_score")).otherwise(F.col("away_score"))
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    per_fixture = (fact.groupBy("epoch", "side", "step", "fixture")
                       .agg(F.min(gf).alias("gf"), F.min(ga).alias("ga")))
    return per_fixture.groupBy("epoch", "side", "step").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))


def team_features(team: DataFrame) -> DataFrame:
    """WIN4 (lagged cumulative goals for), WIN6 (clean-sheet rate over the last
    5 steps) and WIN5 (prior conceded rate) on the side x step frame."""
    from stepwise.roles import Roles
    r = Roles(entity="side", epoch="epoch", step="step", seq="step", segment=None, target=None)
    t = W.lagged_expanding_sum(team, r, ["gf"], fmt="team_gf_prior")
    t = W.lagged_rolling_rate(t, r, F.col("ga") == 0, 5, "team_cs_rate5")
    t = W.prior_count_and_rate(t, r, "ga", count_name="n_prior_steps", rate_name="ga_prior_rate")
    return t


def build_feature_matrix(fact: DataFrame, standings_rank: DataFrame, min_rows: int = 5,
                         min_epoch: int | None = None, hot_rows: int | None = 5_000_000) -> DataFrame:
    """Lag-safe feature matrix, all segments in one pass (PL1).

    FLT1 (minutes > 0, epoch >= k) and FLT2 (>= ``min_rows`` rows per
    entity-epoch) run before the windows; WIN1-WIN3 share one window spec;
    team and opponent features come from the side x step frame (JN12) and the
    opponent's rank (JN5, default 10).  Standings cover the whole epoch, as in
    the reference (flagged: a past row sees the epoch's final table).

    ``hot_rows``: entity-epoch groups larger than this are split into blocks
    (:mod:`stepwise.operators.hotgroups`); ``None`` uses plain windows only.
    """
    from stepwise.functions.scalars import min_group_size
    from stepwise.plans.bindings import FACT_ROLES as R
    base = fact.where(F.col("minutes") > 0)
    if min_epoch is not None:
        base = base.where(F.col("epoch") >= min_epoch)
    if hot_rows is None:
        base = min_group_size(base, R.group, min_rows)
        out = W.lagged_rolling_mean(base, R, PLAYER_ROLL, ks=(3, 5))
        out = W.lagged_expanding_mean(out, R, TODATE)
        out = W.lag_features(out, R, LAGS)
    else:
        from stepwise.operators.hotgroups import lagged_features
        out = lagged_features(base, R, PLAYER_ROLL, (3, 5), TODATE, LAGS, hot_rows=hot_rows, min_rows=min_rows)
    # side x step table (sides x steps rows): checkpointed once so the own-side
    # and opponent joins share it instead of recomputing it from the fact; broadcast,
    # as are the ranks (sides x epochs), so that the wide rows are not exchanged to meet them
    from stepwise.session import cut_lineage
    team = cut_lineage(team_features(team_step_frame(fact)))
    own = team.select("epoch", "side", "step", "team_gf_prior", "team_cs_rate5")
    opp = team.select("epoch", F.col("side").alias("other_side"), "step",
                      F.col("ga_prior_rate").alias("opp_ga_prior_rate"))
    rank = standings_rank.select("epoch", F.col("side").alias("other_side"), F.col("rank").alias("opp_rank"))
    out = (out.join(F.broadcast(own), ["epoch", "side", "step"], "left")
              .join(F.broadcast(opp), ["epoch", "other_side", "step"], "left")
              .join(F.broadcast(rank), ["epoch", "other_side"], "left")
              .withColumn("opp_rank", F.coalesce(F.col("opp_rank"), F.lit(10).cast("bigint"))))
    feats = feature_names()
    return out.select(*CONTEXT, "points", *feats)


def feature_names() -> list[str]:
    return ([f"{c}_roll{k}" for c in PLAYER_ROLL for k in (3, 5)] + [f"{c}_todate" for c in TODATE]
            + [f"{c}_lag1" for c in LAGS] + ["team_gf_prior", "team_cs_rate5", "opp_ga_prior_rate", "opp_rank"])


#: Features that a segment does not use; the others all do.
SEGMENT_WITHOUT = {
    "AFRICA": ("xg_roll3", "xg_roll5", "goals_roll3", "assists_roll3"),   # few shots, many saves
    "AMERICA": ("saves_roll3", "saves_roll5"),
    "ASIA": ("saves_roll3", "saves_roll5", "goals_roll3"),
    "EUROPE": ("saves_roll3", "saves_roll5", "team_cs_rate5"),
}


def segment_features(segment: str) -> list[str]:
    """The features a segment's models use, in the matrix's order."""
    without = SEGMENT_WITHOUT.get(segment, ())
    return [c for c in feature_names() if c not in without]
