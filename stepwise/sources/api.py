"""Nested API snapshots -> one row per entity x fixture (SRC6, SRC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_live(bootstrap: DataFrame, fixtures: DataFrame, live: DataFrame, step: int,
                 stat_cols: list[str]) -> DataFrame:
    """Join the live element stats of one step with element, team and fixture
    data.

    * ``bootstrap``: one row with ``elements`` (array of structs with id,
      team, element_type, ...) and ``teams`` (array of {id, name}).
    * ``fixtures``: one row per fixture {id, event, finished, team_h, team_a,
      team_h_score, team_a_score, kickoff_time}.
    * ``live``: one row with ``elements`` (array of {id, stats{...}}).

    Each fixture contributes a row for both sides; unknown elements and teams
    without a fixture are dropped; missing stats default to 0.  Finished
    fixtures are preferred when the step has any, else all fixtures of it.
    """
    el = bootstrap.select(F.explode("elements").alias("e")).select("e.*")
    teams = bootstrap.select(F.explode("teams").alias("t")).select(F.col("t.id").alias("team"),
                                                                  F.col("t.name").alias("team_name"))
    fx = fixtures.where(F.col("event") == step)
    has_finished = fx.groupBy().agg(F.max(F.col("finished").cast("int")).alias("_any"))
    fx = (fx.withColumn("_k", F.lit(0)).join(F.broadcast(has_finished.withColumn("_k", F.lit(0))), "_k")
            .where((F.col("_any") == 0) | F.col("finished")).drop("_k", "_any"))
    sides = fx.select(
        F.col("id").alias("fixture"), "kickoff_time", "team_h_score", "team_a_score",
        F.explode(F.array(
            F.struct(F.col("team_h").alias("team"), F.col("team_a").alias("opponent_team"),
                     F.lit(True).alias("was_home")),
            F.struct(F.col("team_a").alias("team"), F.col("team_h").alias("opponent_team"),
                     F.lit(False).alias("was_home")))).alias("s")).select("*", "s.*").drop("s")
    stats = live.select(F.explode("elements").alias("l")).select(F.col("l.id").alias("id"), "l.stats")
    out = (stats.join(el, "id")                       # unknown elements dropped
                .join(teams, "team")
                .join(sides, "team"))                 # teams without a fixture dropped
    present = set(stats.schema["stats"].dataType.fieldNames())
    return out.select(
        F.col("id").alias("element"), "team", "team_name", "fixture", "opponent_team", "was_home",
        "kickoff_time", "team_h_score", "team_a_score", F.lit(step).alias("step"),
        *[F.coalesce(F.col(f"stats.{c}"), F.lit(0)).alias(c) if c in present else F.lit(0).alias(c)
          for c in stat_cols])
