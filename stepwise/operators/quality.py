"""Data-quality rules (DQ0-DQ18).

A rule is a function returning a **one-row** DataFrame with a ``violations``
column (and optional ``detail``).  :func:`run_checks` unions every rule into
one ``(rule_id, name, violations, passed, detail)`` table, so the whole audit
is a single Spark job whose scans Catalyst can share; ``strict=True`` raises
after the table is computed (the reference stops at the first failure).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.operators.relational import orphans


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    build: Callable[[], DataFrame]


def row_rules(df: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``{rule_id: (name, violation)}`` as one row per rule, from one aggregate over
    ``df``: the counts are unpivoted after it, so the table is read once."""
    counts = df.groupBy().agg(*[F.count_if(c).alias(i) for i, (_, c) in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(name).alias("name"), F.col(i).alias("violations"))
                               for i, (name, _) in rules.items()]))
    return counts.select(rows.alias("_r")).select("_r.*", F.lit(None).cast("string").alias("detail"))


def run_checks(rules: Sequence[Rule], strict: bool = False, more: Sequence[DataFrame] = ()) -> DataFrame:
    """All rules as one table; ``more`` holds results of :func:`row_rules`."""
    parts = list(more)
    for r in rules:
        one = r.build()
        detail = F.col("detail") if "detail" in one.columns else F.lit(None).cast("string")
        parts.append(one.select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"),
                                F.col("violations").cast("bigint").alias("violations"),
                                detail.alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("passed", F.col("violations") == 0)
    if strict:
        failed = out.where(~F.col("passed")).select("rule_id").collect()   # one row per rule
        if failed:
            raise AssertionError(f"failed rules: {[r.rule_id for r in failed]}")
    return out


def _count(df: DataFrame, cond: Column | None = None) -> DataFrame:
    c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.groupBy().agg(c.alias("violations"))


# DQ1 -------------------------------------------------------------------------
def empty_groups(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Dimension members with no fact rows (counted from the dimension side)."""
    present = fact.select(key).distinct()
    return _count(dim.select(key).distinct().join(present, key, "left_anti"))


def total_in_range(df: DataFrame, lo: int, hi: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy().agg(F.when((n >= lo) & (n <= hi), 0).otherwise(1).alias("violations"),
                            F.concat(F.lit("rows="), n.cast("string")).alias("detail"))


# DQ2 / DQ9 ------------------------------------------------------------------
def orphan_count(child: DataFrame, parent: DataFrame, child_keys: Sequence[str],
                 parent_keys: Sequence[str]) -> DataFrame:
    return _count(orphans(child, parent, child_keys, parent_keys))


# DQ3 -------------------------------------------------------------------------
def null_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return _count(df, cond)


# DQ4 -------------------------------------------------------------------------
def group_cardinality(df: DataFrame, by: Sequence[str], member: str, expected: int) -> DataFrame:
    g = df.groupBy(*by).agg(F.count_distinct(member).alias("_n"))
    return _count(g, F.col("_n") != expected)


# DQ5 / DQ6 / DQ12 ------------------------------------------------------------
def sums_disagree(left: DataFrame, right: DataFrame, keys: Sequence[str], lcol: str, rcol: str,
                  tol: float) -> DataFrame:
    a = left.groupBy(*keys).agg(F.sum(lcol).alias("_a"))
    b = right.groupBy(*keys).agg(F.sum(rcol).alias("_b"))
    j = a.join(b, list(keys), "left")
    return _count(j, F.abs(F.col("_a") - F.coalesce(F.col("_b"), F.lit(0))) > tol)


# DQ7 -------------------------------------------------------------------------
def step_range(df: DataFrame, by: Sequence[str], step: str, first: int, last: int) -> DataFrame:
    g = df.groupBy(*by).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    return _count(g, (F.col("_lo") != first) | (F.col("_hi") != last))


# DQ8 -------------------------------------------------------------------------
def null_before(df: DataFrame, epoch: str, k: int, col: str) -> DataFrame:
    """Rows of epochs before ``k`` where ``col`` is (unexpectedly) filled."""
    return _count(df, (F.col(epoch) < k) & F.col(col).isNotNull())


# DQ10 ------------------------------------------------------------------------
def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Several domain rules in one pass: one ``count_if`` per rule."""
    return df.groupBy().agg(*[F.count_if(c).alias(n) for n, c in rules.items()])


# DQ11 ------------------------------------------------------------------------
def outlier_summary(df: DataFrame, by: Sequence[str], col: str, z: float = 3.0) -> DataFrame:
    stats = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                                F.min(col).alias("min"), F.max(col).alias("max"),
                                F.count(col).alias("n"))
    j = df.select(*by, col).join(stats, list(by))
    out = j.groupBy(*by).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("min").alias("min"),
        F.first("max").alias("max"), F.first("n").alias("n"),
        F.count_if(F.abs(F.col(col) - F.col("mean")) > F.lit(z) * F.col("std")).alias("n_outliers"))
    return out


# DQ14 ------------------------------------------------------------------------
def distinct_per_group(df: DataFrame, by: Sequence[str], col: Column | str, expected: int) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    g = df.groupBy(*by).agg(F.count_distinct(c).alias("_n"))
    return _count(g, F.col("_n") != expected)


# DQ17 / DQ18 -----------------------------------------------------------------
def many_to_one_violations(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys mapped to more than one value (identity reuse, entity in two sides)."""
    return distinct_per_group(df, key, value, 1)
