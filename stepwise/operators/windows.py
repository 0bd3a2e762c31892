"""Window operators (WIN1-WIN14).

All lag-safe features share one window spec ``Roles.window()`` -- partition by
``(entity, epoch)``, order by ``(step, seq)`` -- so Catalyst plans one exchange
and one sort for the whole feature block.  Frames end at ``-1`` so a row never
sees itself.  Groups are bounded by the number of steps in an epoch; for
unbounded groups see :mod:`stepwise.operators.hotgroups`, which computes the
same features with hot groups split into blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.positions import exact_quantiles, join_null_safe
from stepwise.roles import Roles

UNB = Window.unboundedPreceding


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


# WIN1 -------------------------------------------------------------------------
def lagged_rolling_mean(df: DataFrame, roles: Roles, cols: Iterable[str],
                        ks: Sequence[int] = (3, 5), fmt: str = "{c}_roll{k}") -> DataFrame:
    """Mean of the previous ``k`` rows (``shift(1).rolling(k, min_periods=1).mean()``)."""
    w = roles.window()
    return df.withColumns({fmt.format(c=c, k=k): F.avg(c).over(w.rowsBetween(-k, -1))
                           for c in cols for k in ks})


# WIN2 -------------------------------------------------------------------------
def lagged_expanding_mean(df: DataFrame, roles: Roles, cols: Iterable[str],
                          fmt: str = "{c}_todate") -> DataFrame:
    """Epoch-to-date mean over all earlier rows."""
    w = roles.window().rowsBetween(UNB, -1)
    return df.withColumns({fmt.format(c=c): F.avg(c).over(w) for c in cols})


# WIN3 -------------------------------------------------------------------------
def lag_features(df: DataFrame, roles: Roles, cols: Iterable[str], n: int = 1,
                 fmt: str = "{c}_lag{n}") -> DataFrame:
    w = roles.window()
    return df.withColumns({fmt.format(c=c, n=n): F.lag(c, n).over(w) for c in cols})


# WIN4 -------------------------------------------------------------------------
def lagged_expanding_sum(df: DataFrame, roles: Roles, cols: Iterable[str],
                         fmt: str = "{c}_cum_prior") -> DataFrame:
    """Sum of all earlier rows; null on the first row of each group."""
    w = roles.window().rowsBetween(UNB, -1)
    return df.withColumns({fmt.format(c=c): F.sum(c).over(w) for c in cols})


# WIN5 -------------------------------------------------------------------------
def prior_count_and_rate(df: DataFrame, roles: Roles, col: str,
                         count_name: str = "n_prior", rate_name: str | None = None) -> DataFrame:
    """Rows before this one, and ``lagged sum / prior count`` (0 prior -> null)."""
    w = roles.window()
    rate_name = rate_name or f"{col}_prior_rate"
    prior = F.sum(col).over(w.rowsBetween(UNB, -1))
    n = (F.row_number().over(w) - 1).cast("bigint")
    return (df.withColumn(count_name, n)
              .withColumn(rate_name, prior / F.nullif(F.col(count_name), F.lit(0))))


# WIN6 -------------------------------------------------------------------------
def lagged_rolling_rate(df: DataFrame, roles: Roles, flag: Column, k: int, name: str) -> DataFrame:
    """Share of the previous ``k`` rows where ``flag`` holds (null flags skipped)."""
    w = roles.window().rowsBetween(-k, -1)
    return df.withColumn(name, F.avg(flag.cast("double")).over(w))


# WIN7 -------------------------------------------------------------------------
def multi_key_rank(df: DataFrame, partition: Sequence[str], order_desc: Sequence[str],
                   name: str = "rank") -> DataFrame:
    """SQL ``RANK`` (ties share a rank, next rank skipped) on several keys."""
    w = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order_desc])
    return df.withColumn(name, F.rank().over(w).cast("bigint"))


# WIN8 -------------------------------------------------------------------------
def group_count_share(df: DataFrame, partition: Sequence[str], count_col: str | None = None,
                      count_name: str = "group_n", share_name: str | None = None) -> DataFrame:
    """Per-row group size (``transform('count')``) and, with ``count_col``,
    the row's share of the group total."""
    w = Window.partitionBy(*partition)
    out = df.withColumn(count_name, F.count(F.lit(1)).over(w))
    if count_col and share_name:
        out = out.withColumn(share_name, F.col(count_col) / F.sum(count_col).over(w))
    return out


# WIN9 -------------------------------------------------------------------------
def inclusive_rolling_mean(df: DataFrame, roles: Roles, col: str, k: int,
                           roll_name: str | None = None, cum_name: str | None = None,
                           scale: int | None = 2) -> DataFrame:
    """Rolling and expanding mean **including** the current row."""
    w = roles.window()
    roll = F.avg(col).over(w.rowsBetween(-(k - 1), 0))
    cum = F.avg(col).over(w.rowsBetween(UNB, 0))
    if scale is not None:
        roll, cum = F.round(roll, scale), F.round(cum, scale)
    return df.withColumns({roll_name or f"{col}_roll{k}_incl": roll,
                           cum_name or f"{col}_cum_incl": cum})


# WIN10 ------------------------------------------------------------------------
def rolling_alert(df: DataFrame, partition: Sequence[str], order: Sequence[str], metric: str,
                  threshold: Column | float, k: int = 5,
                  roll_name: str = "rolling", alert_name: str = "alert") -> DataFrame:
    """Rolling mean of the last ``k`` logged slices (current included) and an
    alert flag when it exceeds ``threshold``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(k - 1), 0)
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (df.withColumn(roll_name, F.avg(metric).over(w))
              .withColumn(alert_name, F.col(roll_name) > thr))


# WIN11 ------------------------------------------------------------------------
def lag1_pairs(df: DataFrame, roles: Roles, col: str, name: str | None = None) -> DataFrame:
    """Current value next to the previous one inside the group, null pairs dropped."""
    name = name or f"{col}_prev"
    return (df.withColumn(name, F.lag(col, 1).over(roles.window()))
              .where(F.col(name).isNotNull() & F.col(col).isNotNull()))


# WIN12 ------------------------------------------------------------------------
def quantile_bins(df: DataFrame, col: str, q: int = 10, by: Sequence[str] = (),
                  name: str = "bin") -> DataFrame:
    """``pd.qcut(x, q, duplicates='drop')``: right-closed bins on distinct
    exact quantile edges, lowest value included in the first bin.

    Edges are exact quantiles by positions; the edge table holds one row per
    ``by`` group, so it is joined back (broadcast by AQE when small), never collected.
    """
    names = [f"_e{i}" for i in range(q + 1)]
    edges = exact_quantiles(df, by, col, [i / q for i in range(q + 1)], names)
    edges = edges.select(*by, F.array_distinct(F.array(*names)).alias("_edges"))
    x = F.col(col)
    # bin = number of interior edges strictly below x (right-closed), min 0
    interior = F.slice(F.col("_edges"), 2, F.size("_edges") - 2)
    idx = F.size(F.filter(interior, lambda e: e < x))
    if by:
        joined = join_null_safe(df, edges, by, "left")
    else:
        # one-row global aggregate: a proven size bound, so broadcast it.
        joined = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return (joined.withColumn(name, F.when(x.isNull(), None).otherwise(idx).cast("int"))
                  .drop("_edges"))


# WIN13 ------------------------------------------------------------------------
def top_n_per_group(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int,
                    rank_name: str | None = None) -> DataFrame:
    """``row_number() <= n``; ``order`` must end in a key tie-break.

    Catalyst plans this as a per-partition top-k (``WindowGroupLimit``) before
    the shuffle, so only ``n`` rows per group travel.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_name) if rank_name else out.drop("_rn")


# WIN14 ------------------------------------------------------------------------
def median_flag(df: DataFrame, partition: Sequence[str], col: str, extra: Column | None = None,
                median_name: str = "segment_median", flag_name: str = "flag",
                skew_safe: bool = True) -> DataFrame:
    """Flag rows at or above their group's median (optionally AND ``extra``).

    The median is an exact quantile by positions joined back, not a window, so
    no task holds a group (``skew_safe`` is always on).
    """
    med = exact_quantiles(df, partition, col, [0.5], [median_name])
    out = join_null_safe(df, med, partition, "left")
    cond = F.col(col) >= F.col(median_name)
    if extra is not None:
        cond = cond & extra
    return out.withColumn(flag_name, F.coalesce(cond, F.lit(False)))
