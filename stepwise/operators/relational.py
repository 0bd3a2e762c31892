"""Joins, set operations and sorts (JN1-JN17, SET1-SET5, SRT1-SRT5).

Join strategy policy
--------------------
* A side gets an explicit ``broadcast`` hint only when its size is bounded by
  construction (fixed dimensions such as nation/region, one row per epoch,
  segment or fold, a one-row scalar).  :func:`bounded` documents that bound.
* Every other join is left to Catalyst + AQE: the runtime shuffle statistics
  decide between a broadcast hash join (below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``) and a sort-merge join,
  and AQE splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(df: DataFrame, max_rows: int, why: str) -> DataFrame:  # noqa: ARG001
    """Broadcast a side whose row count is bounded by construction.

    ``max_rows`` and ``why`` record the bound next to the call site, e.g.
    ``bounded(edges, 1, "one global row")`` or ``bounded(nation, 25, "TPC-H")``.
    """
    return F.broadcast(df)


# JN1 -------------------------------------------------------------------------
def bridge_join(df: DataFrame, bridge: DataFrame, on: Sequence[str], stable: str) -> tuple[DataFrame, DataFrame]:
    """Map a local id to the stable key; drop unmatched rows.

    Also returns a lazy one-row ``(unmatched, rows)`` count of the same join
    -- evaluated only if the caller asks for it, and free of session-level
    observation state (which Spark ML task closures cannot serialise)."""
    joined = df.join(bridge, list(on), "left")
    counts = joined.agg(F.count_if(F.col(stable).isNull()).alias("unmatched"), F.count(F.lit(1)).alias("rows"))
    return joined.where(F.col(stable).isNotNull()), counts


# JN3 -------------------------------------------------------------------------
def own_side_from_other(df: DataFrame, match_keys: Sequence[str], is_home: str,
                        other_side: str, name: str = "own_side") -> DataFrame:
    """A row's own side = the ``other_side`` named by rows of the opposite venue
    in the same match (min instead of an order-dependent ``first``)."""
    w = Window.partitionBy(*match_keys)
    home_side = F.min(F.when(~F.col(is_home).cast("boolean"), F.col(other_side))).over(w)
    away_side = F.min(F.when(F.col(is_home).cast("boolean"), F.col(other_side))).over(w)
    return df.withColumn(name, F.when(F.col(is_home).cast("boolean"), home_side).otherwise(away_side))


# JN5 -------------------------------------------------------------------------
def left_with_default(df: DataFrame, other: DataFrame, on: Sequence[str],
                      defaults: dict) -> DataFrame:
    out = df.join(other, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# JN6 / JN7 -------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, child_keys: Sequence[str],
            parent_keys: Sequence[str] | None = None, not_in: bool = False) -> DataFrame:
    """Child rows whose key is absent from the parent (``NOT EXISTS``).

    ``not_in=True`` follows the ``NOT IN`` form: rows with a null in any child
    key are dropped first (they can never be reported by ``NOT IN``).
    """
    parent_keys = list(parent_keys or child_keys)
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_keys, child_keys)]).distinct()
    c = child
    if not_in:
        c = c.dropna(subset=list(child_keys))
    return c.join(p, list(child_keys), "left_anti")


def keep_known(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


# JN8 -------------------------------------------------------------------------
def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], lcol: str, rcol: str,
              tol: float, lname: str = "left_total", rname: str = "right_total") -> DataFrame:
    """Pre-aggregate both sides on ``keys``, left-join, keep |diff| > tol."""
    a = left.groupBy(*keys).agg(F.sum(lcol).alias(lname))
    b = right.groupBy(*keys).agg(F.sum(rcol).alias(rname))
    out = a.join(b, list(keys), "left").withColumn(
        "diff", F.col(lname) - F.coalesce(F.col(rname), F.lit(0)))
    return out.where(F.abs(F.col("diff")) > tol)


# JN9 -------------------------------------------------------------------------
def last_n_steps(df: DataFrame, step: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the last ``n`` steps (``step > max(step) - n``), per ``by``.

    The max is a one-row (or one-row-per-``by``) aggregate joined back."""
    mx = df.groupBy(*by).agg(F.max(step).alias("_max_step"))
    if by:
        out = df.join(mx, list(by))
    else:
        out = df.withColumn("_k", F.lit(0)).join(
            bounded(mx.withColumn("_k", F.lit(0)), 1, "one global row"), "_k").drop("_k")
    return out.where(F.col(step) > F.col("_max_step") - n).drop("_max_step")


# JN10 ------------------------------------------------------------------------
def consecutive_pairs(df: DataFrame, keys: Sequence[str], step: str, cols: Sequence[str]) -> DataFrame:
    """Pair every row with the row of ``step + 1`` for the same keys (a gap
    never pairs; double steps fan out, as the SQL self join does)."""
    nxt = df.select(*keys, (F.col(step) - 1).alias(step),
                    *[F.col(c).alias(f"{c}_next") for c in cols], F.col(step).alias(f"{step}_next"))
    return df.select(*keys, step, *cols).join(nxt, list(keys) + [step])


# JN13 ------------------------------------------------------------------------
def refresh_from_facts(dim: DataFrame, fact: DataFrame, key: Sequence[str], col: str,
                       source: str) -> DataFrame:
    """``UPDATE dim SET col = (SELECT max(source) ...) WHERE EXISTS``:
    aggregate, left join, keep the old value where no fact exists."""
    agg = fact.groupBy(*key).agg(F.max(source).alias("_new"))
    return (dim.join(agg, list(key), "left")
               .withColumn(col, F.coalesce(F.col("_new"), F.col(col))).drop("_new"))


# JN14 ------------------------------------------------------------------------
def prior_epoch(df: DataFrame, stats: DataFrame, entity: str, epoch: str,
                cols: Sequence[str], fmt: str = "{c}_prev_epoch") -> DataFrame:
    """Attach ``stats`` of ``(entity, epoch - 1)``."""
    prev = stats.select(F.col(entity), (F.col(epoch) + 1).alias(epoch),
                        *[F.col(c).alias(fmt.format(c=c)) for c in cols])
    return df.join(prev, [entity, epoch], "left")


# SET3 ------------------------------------------------------------------------
def column_drift(expected: Sequence[str], actual: Sequence[str]) -> tuple[list[str], list[str]]:
    """(new columns, dropped columns) -- schema metadata only, no data job."""
    e, a = set(expected), set(actual)
    return sorted(a - e), sorted(e - a)


# SET4 ------------------------------------------------------------------------
def top_set_overlap(df: DataFrame, by: Sequence[str], a: str, b: str, key: str, n: int) -> DataFrame:
    """Size of the intersection of the top-``n`` by ``a`` and by ``b`` per group.

    Both lists are ``row_number() <= n`` filters, so only ``n`` rows per group
    and task are sorted together; ``key`` identifies a row within its group."""
    def top(c: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col(c).desc(), F.col(key))
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select(*by, key)

    both = top(a).intersect(top(b)).groupBy(*by).agg(F.count(F.lit(1)).alias("overlap"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(both, list(by), "left").select(*by, F.coalesce("overlap", F.lit(0).cast("bigint")).alias("overlap"), "n")


# SET5 ------------------------------------------------------------------------
def missing_members(df: DataFrame, by: Sequence[str], col: str, lo: int, hi: int | Column) -> DataFrame:
    """Members of ``lo..hi`` absent from ``col`` per group (EXCEPT)."""
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    keys = df.select(*by).distinct().withColumn(col, F.explode(F.sequence(F.lit(lo), hi_c)))
    present = df.select(*by, col).distinct()
    return keys.join(present, list(by) + [col], "left_anti")


# SRT1 / SRT2 / SRT3 / SRT4 --------------------------------------------------
def top_k(df: DataFrame, order: Sequence[Column], k: int, allowed: Sequence[str] | None = None,
          sort_col: str | None = None) -> DataFrame:
    """``ORDER BY ... LIMIT k`` with an optional whitelisted sort column.

    Spark plans ``TakeOrderedAndProject``: each task keeps its own top ``k``
    and only those rows are merged.
    """
    if allowed is not None and sort_col is not None and sort_col not in allowed:
        raise ValueError(f"sort column {sort_col!r} not allowed")
    return df.orderBy(*order).limit(k)


# SRT5 ------------------------------------------------------------------------
def arg_extremes(df: DataFrame, by: Sequence[str], label: str, value: str) -> DataFrame:
    """Label of the peak and trough value per group (``max_by``/``min_by``)."""
    return df.groupBy(*by).agg(F.max_by(label, value).alias(f"peak_{label}"),
                               F.max(value).alias(f"peak_{value}"),
                               F.min_by(label, value).alias(f"trough_{label}"),
                               F.min(value).alias(f"trough_{value}"))


# JN11 / JN15 ------------------------------------------------------------------
def reattach(features: DataFrame, raw: DataFrame, keys: Sequence[str], cols: Sequence[str],
             defaults: dict | None = None) -> DataFrame:
    """Left-join raw columns back to feature rows on their full key
    (``epoch, step, seq, entity``), with optional fallbacks (minutes -> 60).

    The raw rows are a fact table, small on disk and large in memory, so they are
    merged and never gathered in the driver for a broadcast."""
    out = features.join(raw.select(*keys, *cols).hint("merge"), list(keys), "left")
    if defaults:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out
