"""Dashboard tables (V1-V24): the data behind each chart or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.scalars import abbrev3, rank_difficulty, venue_label
from stepwise.operators.positions import exact_quantiles, join_null_safe
from stepwise.operators.windows import median_flag, top_n_per_group
from stepwise.plans.slices import select_slice


def quadrants(df: DataFrame, by: Sequence[str], x: str, y: str, labels=("high-high", "high-low", "low-high", "low-low"),
              name: str = "quadrant") -> DataFrame:
    """Label rows by whether ``x`` and ``y`` are at or above their group
    medians (exact quantiles by positions, joined back)."""
    j = df
    for col, median in ((x, "_mx"), (y, "_my")):
        med = exact_quantiles(df, by, col, [0.5], [median])
        # one row per group: the join strategy is left to AQE (runtime size);
        # only the single global row is broadcast explicitly
        j = join_null_safe(j, med, by, "left") if by else \
            j.withColumn("_k", F.lit(0)).join(F.broadcast(med.withColumn("_k", F.lit(0))), "_k", "left").drop("_k")
    hx, hy = F.col(x) >= F.col("_mx"), F.col(y) >= F.col("_my")
    q = (F.when(hx & hy, labels[0]).when(hx & ~hy, labels[1]).when(~hx & hy, labels[2]).otherwise(labels[3]))
    return j.withColumn(name, q).drop("_mx", "_my")


# V3 / V6
def side_strength(fact: DataFrame) -> DataFrame:
    gf = F.when(F.col("is_home") == 1, F.col("home_score")).otherwise(F.col("away_score"))
    ga = F.when(F.col("is_home") == 1, F.col("away_score")).otherwise(F.col("home_score"))
    per_fixture = fact.select("epoch", "side", "fixture", gf.alias("gf"), ga.alias("ga")).distinct()
    return per_fixture.groupBy("epoch", "side").agg(F.avg("gf").alias("attack"), F.avg("ga").alias("defence"),
                                                    F.count(F.lit(1)).alias("fixtures"))


def by_epoch(strength: DataFrame, value: str, epochs: Sequence[int]) -> DataFrame:
    """V3's heat map: a side a row, its ``value`` in each epoch a column."""
    wide = strength.groupBy("side").pivot("epoch", list(epochs)).agg(F.first(value))
    return wide.select("side", *[F.col(str(e)).alias(f"{value}_{e}") for e in epochs])


# V23
def top_lists(pred: DataFrame, by: Sequence[str], y: str, key: Sequence[str], n: int = 5) -> DataFrame:
    """A slice's best by prediction and by actual value, with the error of each."""
    rows = pred.where(F.col("pred").isNotNull() & F.col(y).isNotNull()).withColumn("abs_error", F.abs(F.col("pred") - F.col(y)))
    lists = [top_n_per_group(rows, by, [F.col(c).desc(), *[F.col(k) for k in key]], n, rank_name="place").withColumn("list", F.lit(name))
             for name, c in (("predicted", "pred"), ("actual", y))]
    return lists[0].unionByName(lists[1]).select(*by, "list", "place", *key, "pred", y, "abs_error")


def slice_summary(pred: DataFrame, by: Sequence[str], y: str, threshold: float, k: int = 5) -> DataFrame:
    """Metrics of the newest slice with its rolling MAE over the last ``k`` slices and the alert."""
    from stepwise.operators import stats as ST
    from stepwise.operators.windows import rolling_alert
    m = ST.regression_metrics(pred, [*by, "epoch", "step"], y, "pred")
    log = rolling_alert(m, by, ["epoch", "step"], "mae", threshold, k, "rolling_mae", "alert")
    now = select_slice(pred.where(F.col("pred").isNotNull()), "epoch", "step")
    return select_slice(log, "epoch", "step").join(ST.spearman(now, by, "pred", y), list(by), "left")


# V13
def difficulty_calendar(fact: DataFrame, rank: DataFrame, names: DataFrame, epoch: int) -> DataFrame:
    """Side x step: first opponent of the step, its abbreviation and the
    difficulty from the opponent's rank (AGG8 + PRJ17 + PRJ20)."""
    f = fact.where(F.col("epoch") == epoch)
    first = f.groupBy("side", "step").agg(F.min_by("other_side", F.struct("fixture")).alias("opponent"))
    r = rank.where(F.col("epoch") == epoch).select(F.col("side").alias("opponent"), "rank")
    n = names.select(F.col("n_nationkey").alias("opponent"), abbrev3(F.col("n_name")).alias("opp_abbr"))
    return (first.join(r, "opponent", "left").join(F.broadcast(n), "opponent", "left")
                 .withColumn("difficulty", rank_difficulty(F.col("rank"))).drop("rank"))


# V16
def boom_bust(fact: DataFrame, min_rows: int = 5) -> DataFrame:
    g = (fact.groupBy("entity", "epoch").agg(F.avg("points").alias("mean"), F.stddev_samp("points").alias("std"),
                                             F.count(F.lit(1)).alias("n"))
             .where((F.col("n") >= min_rows) & F.col("std").isNotNull()))
    return quadrants(g, ["epoch"], "mean", "std", ("boom-bust", "steady-high", "volatile-low", "steady-low"))


# V17
def value_picks(fact: DataFrame, epoch: int, n: int) -> DataFrame:
    g = (fact.where(F.col("epoch") == epoch).groupBy("segment", "entity")
             .agg(F.sum("points").alias("points"), F.max_by("price", F.struct("step", "fixture")).alias("price"))
             .withColumn("points_per_price", F.col("points") / F.nullif(F.col("price") / F.lit(10.0), F.lit(0.0))))
    w = Window.partitionBy("segment").orderBy(F.col("points_per_price").desc(), "entity")
    return g.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


# V20
def price_trajectory(fact: DataFrame) -> DataFrame:
    per_step = fact.groupBy("entity", "epoch", "step").agg(F.max("price").alias("price"),
                                                           F.sum("points").alias("points"))
    return per_step.groupBy("entity", "epoch").agg(
        F.min_by("price", "step").alias("start_price"), F.max_by("price", "step").alias("end_price"),
        (F.max_by("price", "step") - F.min_by("price", "step")).alias("delta"), F.sum("points").alias("points"))


# V12
def ranked_predictions(pred: DataFrame, by: Sequence[str], price: str, rank: str, selected: str, n: int,
                       max_ownership: float = 10.0, differentials: bool = False) -> DataFrame:
    """Top ``n`` predictions per group with price, opponent difficulty, ownership
    share and the differential flag (at or above the group's median, owned by
    less than ``max_ownership`` per cent of the group's selections)."""
    total = pred.groupBy(*by).agg(F.sum(selected).alias("_all"))
    p = (pred.join(total, list(by), "left")
             .withColumn("price", F.round(F.col(price) / 10.0, 1)).withColumn("difficulty", rank_difficulty(F.col(rank)))
             .withColumn("ownership_pct", F.lit(100.0) * F.col(selected) / F.nullif(F.col("_all"), F.lit(0))))
    p = median_flag(p, by, "pred", F.col("ownership_pct") < max_ownership, flag_name="differential")
    if differentials:
        p = p.where("differential")
    return top_n_per_group(p, by, [F.col("pred").desc(), F.col("entity"), F.col("fixture")], n, rank_name="pick").select(
        *by, "entity", "fixture", "pred", "price", "difficulty", "ownership_pct", "differential", "pick")


# V14
def captain_candidates(pred: DataFrame, rank: str, n: int = 3) -> DataFrame:
    """The ``n`` best predictions of a slice, whatever the price."""
    return (pred.withColumn("difficulty", rank_difficulty(F.col(rank))).withColumn("venue", venue_label(F.col("is_home"), short=True))
                .orderBy(F.col("pred").desc(), "entity", "fixture").limit(n)
                .select("entity", "fixture", "segment", "side", "other_side", "venue", "difficulty", "pred"))


# V22
def latest_status(log: DataFrame, threshold: float) -> DataFrame:
    """Each segment's row of the newest logged slice with its status."""
    return (select_slice(log, "epoch", "step").withColumn("threshold", F.lit(threshold))
            .withColumn("status", F.when(F.col("alert"), "ALERT").otherwise("PASS"))
            .select("segment", "epoch", "step", "mae", "threshold", "status"))
