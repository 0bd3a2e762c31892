"""Exact positions inside a group of any size.

A window over a whole group sorts it in one task.  Here rows are put in order
by ranges of (group, order) instead, which cut a large group into as many
ranges as it needs; a row's position is the sum of the ranges before its own
plus what stands before it in its range.  Ranges are frozen in a written table,
as their borders are sampled.  Nothing depends on a size constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.session import write_and_reload

#: Rows (group, value) of a table of ranks that is sent to all tasks; a larger one is joined by shuffling.
FEW_VALUES = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name in which null equals null; they come from the left."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], F.lit(True))
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def prefix(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str | None = None,
           name: str = "before", total: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add the rows (or their ``weight``) that stand before a row in its group, and the group's ``total``.

    Rows equal in ``order`` follow each other in any order.  ``buckets`` is the number of
    ranges; by default Spark chooses it by size."""
    group, order = list(group), list(order)
    cols = [*group, *order]
    cut = write_and_reload((df.repartitionByRange(buckets, *cols) if buckets else df.repartitionByRange(*cols)).withColumn("_range", F.spark_partition_id()), "ranges")
    w = F.lit(1) if weight is None else F.col(weight)
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range
    sums = cut.groupBy(*group, "_range").agg(F.sum(w).alias("_sum"))
    ranges = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_sum").over(Window.partitionBy(*group)))
    out = cut.withColumn("_in", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = join_null_safe(out, offsets.drop("_sum"), [*group, "_range"])
    return out.withColumn(name, F.col("_off") + F.col("_in")).drop("_off", "_in", "_range")


def value_positions(df: DataFrame, by: Sequence[str], col: str, buckets: int | None = None) -> DataFrame:
    """Rows (by..., col, _n, _before, _total), one per group and value: ties are one row before they are ordered."""
    vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    return prefix(vals, by, [col], "_n", "_before", "_total", buckets)


def average_rank(df: DataFrame, by: Sequence[str], col: str, name: str, buckets: int | None = None) -> DataFrame:
    """Add the 1-based average rank of ``col`` within ``by`` (ties share the mean of their
    positions, as ``pandas.rank()``); nulls get a null rank."""
    ranks = value_positions(df, by, col, buckets).select(*by, col, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return join_null_safe(df, ranks, [*by, col], "left")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (``numpy``/``quantile_cont`` semantics) per group.

    A wanted position lies in one value's range of positions, so each group's quantiles
    are a maximum over its values; no task holds a group or a map of its values."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])

    def at(k: Column) -> Column:
        return F.max(F.when((k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")), F.col(col)))

    aggs = []
    for p, name in zip(probs, names):
        t = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = at(F.floor(t)), at(F.ceil(t))
        aggs.append((lo + (hi - lo) * F.max(t - F.floor(t))).alias(name))
    return value_positions(df, by, col, buckets).groupBy(*by).agg(*aggs)


def _tied(n_keys: int):
    """Task function: batches of (keys..., x, c) to rows (keys..., x, n, s), a batch's rows of one key and value as one:
    their number and the sum of their ``c``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(n_keys)
            # grouped by value, in any order; what numpy has no numbers for goes by its place in a dictionary
            plain = pa.types.is_floating(x.type) or pa.types.is_integer(x.type)
            x = (x if plain else x.dictionary_encode().indices).to_numpy(zero_copy_only=False)
            code = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[:n_keys]:
                e = c.dictionary_encode(null_encoding="encode")
                code = np.unique(code, return_inverse=True)[1] * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((x, code))
            x, code = x[order], code[order]
            first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (code[1:] != code[:-1])))
            n = np.diff(first, append=len(order))
            s = np.add.reduceat(batch.column(n_keys + 1).to_numpy(zero_copy_only=False)[order], first)
            out = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*out.columns[:n_keys + 1], pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=[*batch.schema.names[:n_keys + 1], "n", "s"])
    return run


def _range_sums(n_keys: int):
    """Task function: a range of rows (keys..., x, n, s) in order to rows (keys..., range, n, s, rs, ties), one per key: its
    rows, their ``s``, the sum of average rank in the range times ``s``, and of t^3 - t over its runs of t equal values."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        here, key, total, open_ = TaskContext.get().partitionId(), None, None, None
        form: list = []

        def value(n, s):   # the next value of the key; n, s: arrays or numbers
            r = total[0] + np.cumsum(n) - n + (n + 1) / 2
            t = np.asarray(n, float)
            total[0] += int(np.sum(n))
            total[1] += float(np.sum(s))
            total[2] += float(np.sum(r * s))
            total[3] += float(np.sum(t ** 3 - t))

        def row():
            value(np.array([open_[1]]), np.array([open_[2]]))
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(key, form)], pa.array([here], pa.int32()), pa.array([total[0]], pa.int64()),
                                               *[pa.array([v], pa.float64()) for v in total[1:]]], names=[*[f"k{i}" for i in range(n_keys)], "range", "n", "s", "rs", "ties"])

        for batch in batches:
            if not batch.num_rows:
                continue
            form = [c.type for c in batch.columns[:n_keys]]
            x = batch.column(n_keys).to_numpy(zero_copy_only=False)
            n, s = (batch.column(n_keys + i).to_numpy(zero_copy_only=False) for i in (1, 2))
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in batch.columns[:n_keys]:
                e = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= e[1:] != e[:-1]
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                own = tuple(c[int(a)].as_py() for c in batch.columns[:n_keys])
                v = x[a:b]
                differs = v[1:] != v[:-1]
                if v.dtype.kind == "f":   # not a number is one value
                    differs &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
                at = np.flatnonzero(np.append(True, differs))
                nv, sv = np.add.reduceat(n[a:b], at), np.add.reduceat(s[a:b], at)
                if key is None or own != key:
                    if key is not None:
                        yield row()
                    key, total = own, [0, 0.0, 0.0, 0.0]
                elif v[0] == open_[0] or (v[0] != v[0] and open_[0] != open_[0]):
                    nv[0] += open_[1]
                    sv[0] += open_[2]
                else:
                    value(np.array([open_[1]]), np.array([open_[2]]))
                value(nv[:-1], sv[:-1])
                open_ = v[-1], nv[-1], sv[-1]   # the next batch may go on with it
        if key is not None:
            yield row()
    return run


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Pearson correlation of the average ranks of two columns per group, null where one does not vary; no null in ``x`` or ``y``.

    Only ``y`` is ranked row by row, by a table of its values.  Rows then go to ranges of (group, x), equal values of a
    batch as one row, and a range hands on one row of sums per group, to which the rows before the range are added.  So
    the rows of a large group travel once, and no task holds them."""
    by = list(by)
    at = write_and_reload(value_positions(df, by, y).select(*by, y, "_n", (F.col("_before") + (F.col("_n") - F.col("_total")) / 2.0).alias("_c")), "value-ranks")
    t = F.col("_n").cast("double")
    # sums of squares of centred ranks are those without ties, less what the ties take
    of_y = at.groupBy(*by).agg(F.sum(t).alias("_all"), F.sum(t * t * t - t).alias("_ties_y"))
    ranks = at.select(*by, y, "_c")
    if at.count() <= FEW_VALUES:
        ranks = F.broadcast(ranks)
    rows = join_null_safe(df.select(*by, x, y), ranks, [*by, y]).select(*by, x, "_c")
    tied = rows.mapInArrow(_tied(len(by)), T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())]))
    named = [T.StructField(f"k{i}", rows.schema[c].dataType) for i, c in enumerate(by)]
    sums = tied.repartitionByRange(*by, x).sortWithinPartitions(*by, x).mapInArrow(_range_sums(len(by)), T.StructType(
        [*named, T.StructField("range", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("s", "rs", "ties")]]))
    sums = sums.withColumnsRenamed({f"k{i}": c for i, c in enumerate(by)})
    # one row per group and range
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy(*by).agg(
        F.sum(F.col("_off") * F.col("s") + F.col("rs")).alias("_rs"), F.sum("s").alias("_s"), F.sum("ties").alias("_ties_x"))
    out = join_null_safe(sums, of_y, by)
    cube = F.col("_all") * F.col("_all") * F.col("_all") - F.col("_all")
    co = F.col("_rs") - (F.col("_all") + 1) / 2.0 * F.col("_s")
    return out.select(*by, (co * 12.0 / F.nullif(F.sqrt(cube - F.col("_ties_x")) * F.sqrt(cube - F.col("_ties_y")), F.lit(0.0))).alias(name))
