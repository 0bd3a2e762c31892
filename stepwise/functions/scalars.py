"""Scalar expressions and filters (PRJ1-PRJ23, FLT1-FLT6).

Every helper returns a ``Column`` (or a DataFrame for multi-column steps)
built from JVM builtins, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# PRJ1 -------------------------------------------------------------------------
def col_or_default(df: DataFrame, name: str, default=None, dtype: str | None = None) -> Column:
    c = F.col(name) if name in df.columns else F.lit(default)
    return (c.cast(dtype) if dtype else c).alias(name)


# PRJ2 / PRJ5 ----------------------------------------------------------------
def coerce_numeric(c: Column | str, dtype: str = "double") -> Column:
    """``to_numeric(errors='coerce')``: unparsable -> null.  Integers go
    through double because ``try_cast('1.0' as int)`` is null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    if dtype in ("int", "integer", "bigint", "long", "smallint"):
        d = F.when(F.isnan(d) | (F.abs(d) > 9.2e18), None).otherwise(d)
        return F.floor(d).cast(dtype)
    return F.nanvl(d, F.lit(None).cast("double")) if dtype == "double" else d.cast(dtype)


def count_stat(c: Column | str) -> Column:
    """Counting stat: coerce, null -> 0, integer."""
    return F.coalesce(coerce_numeric(c, "bigint"), F.lit(0).cast("bigint"))


# PRJ3 -------------------------------------------------------------------------
def bool_to_int(c: Column | str) -> Column:
    """bool / 'True' / 1 / '1.0' -> 1, bool / 'False' / 0 / '0.0' -> 0, other text and null -> null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "1.0"), 1).when(s.isin("false", "0", "0.0"), 0)


# PRJ4 -------------------------------------------------------------------------
def code_map(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Literal map lookup (compiled to a constant map, no join)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, c)
    return F.coalesce(out, F.lit(default)) if default is not None else out


# PRJ6 -------------------------------------------------------------------------
def null_unless(df: DataFrame, pred: Column, cols: Iterable[str]) -> DataFrame:
    """Keep a column family only on rows where ``pred`` holds."""
    return df.withColumns({c: F.when(pred, F.col(c)) for c in cols if c in df.columns})


# PRJ7 -------------------------------------------------------------------------
def hash_key(*cols: str) -> Column:
    """Surrogate key for facts: a hash of the natural key (no global order)."""
    return F.xxhash64(*[F.col(c) for c in cols])


def ordinal_key(df: DataFrame, natural: Sequence[str], name: str) -> DataFrame:
    """Dense surrogate key 1..n for small dimensions (ordered by natural key).

    Uses one global ordering, so only for dimensions of bounded size.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*natural)).cast("bigint"))


# PRJ8 -------------------------------------------------------------------------
def derived_with_override(override: Column, base: Column, change: Column) -> Column:
    """``override or (base - change)``: a zero or null override falls back."""
    return F.coalesce(F.nullif(override, F.lit(0)), base - change)


# PRJ9 -------------------------------------------------------------------------
def side_value(is_home: Column, home: Column, away: Column) -> Column:
    return F.when(is_home.cast("boolean"), home).otherwise(away)


# PRJ11 ------------------------------------------------------------------------
def venue_label(is_home: Column, short: bool = False) -> Column:
    h, a = ("H", "A") if short else ("Home", "Away")
    return F.when(is_home.cast("boolean"), h).otherwise(a)


# PRJ12 ------------------------------------------------------------------------
def per90(total: Column, minutes: Column) -> Column:
    """``sum(x) / nullif(sum(min) / 90, 0)`` (ANSI safe)."""
    return total / F.nullif(minutes / F.lit(90.0), F.lit(0.0))


# PRJ13 / PRJ15 / PRJ16 / PRJ17 -------------------------------------------------
def bucket_right_closed(c: Column, edges: Sequence[float], labels: Sequence[str],
                        include_lowest: bool = True) -> Column:
    """``pd.cut(right=True)``: ``(e0, e1], (e1, e2] ...``; outside -> null."""
    assert len(labels) == len(edges) - 1
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (c > lo) & (c <= hi)
        if i == 0 and include_lowest:
            cond = (c >= lo) & (c <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def bucket_left_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``[e0, e1), [e1, e2) ...``; the last edge may be ``inf``."""
    expr = None
    for i, lab in enumerate(labels):
        cond = (c >= edges[i]) & (c < edges[i + 1])
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def bucket_upper_bounds(c: Column, bounds: Sequence[tuple[float, object]], otherwise) -> Column:
    """``CASE WHEN c < b1 THEN l1 WHEN c < b2 ...`` (minutes buckets, bands)."""
    expr = None
    for b, lab in bounds:
        expr = F.when(c < b, lab) if expr is None else expr.when(c < b, lab)
    return expr.otherwise(otherwise)


def rank_difficulty(rank: Column) -> Column:
    """PRJ17: opponent rank -> difficulty 5 (hardest) .. 1; null stays null."""
    return (F.when(rank.isNull(), None).when(rank <= 6, 5).when(rank <= 10, 4)
            .when(rank <= 14, 3).when(rank <= 17, 2).otherwise(1))


def rank_bin(rank: Column, missing: int = 10) -> Column:
    """PRJ18: rank -> A (<=6) / B (<=14) / C, null rank counted as ``missing``."""
    r = F.coalesce(rank, F.lit(missing))
    return F.when(r <= 6, "A").when(r <= 14, "B").otherwise("C")


# PRJ14 ------------------------------------------------------------------------
def fill_then_band(c: Column, fill: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    return bucket_left_closed(F.coalesce(c, fill), edges, labels)


# PRJ19 ------------------------------------------------------------------------
def composite_key(epoch: Column, step: Column, factor: int = 1000) -> Column:
    return epoch.cast("bigint") * factor + step.cast("bigint")


# PRJ20 ------------------------------------------------------------------------
def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def abbrev3(c: Column) -> Column:
    return F.upper(F.substring(c, 1, 3))


# PRJ21 / PRJ22 / PRJ23 -------------------------------------------------------
def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def feature_columns(df: DataFrame, context: Sequence[str], target: str) -> list[str]:
    skip = set(context) | {target}
    return [c for c in df.columns if c not in skip]


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


# FLT3 / FLT6 --------------------------------------------------------------------
def all_of(conds: Iterable[Column | None]) -> Column:
    """AND-fold the given conditions, skipping ``None`` (optional predicates)."""
    cs = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, cs, F.lit(True))


def in_list(c: str, values: Sequence | None) -> Column | None:
    return F.col(c).isin(list(values)) if values else None


# FLT4 / SRC9 ------------------------------------------------------------------
def contains_ci(c: Column, needle: str) -> Column:
    """SQLite ``LIKE '%x%'``: case-insensitive substring."""
    return F.contains(F.lower(c.cast("string")), F.lower(F.lit(needle)))


# FLT2 -------------------------------------------------------------------------
def min_group_size(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Keep groups with at least ``n`` rows (count joined back from an
    aggregate, so the filter never materialises a group in one task)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return df.join(sizes.select(*group), list(group), "left_semi")
