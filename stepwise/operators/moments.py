"""Moments of a table by (group, epoch), and everything a linear fit takes from them.

One aggregation reads the rows: per group, epoch and pattern of missing values
it keeps the row count and the sums and products of the columns, shifted by a
provisional mean taken from the first few rows.  Any shift gives the same
moments; one near the data keeps the sums from cancelling.  All that follows
works on this small table: missing values are filled, epochs are summed up to
prefix rows, and any run of epochs is the difference of two prefix rows.  No
row is copied per fold.

A missing value takes the mean of its group and epoch, which leaves the mean as
it is and adds nothing to a co-moment about it.  A column without any value in
an epoch takes the mean over the run's other epochs, else 0; as that depends on
the run, prefix rows keep such epochs' sums apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.operators.models import Moments

#: Rows (group, epoch, pattern of missing values) that may come to the driver.
MAX_ROWS = 20_000


def provisional_means(df: DataFrame, cols: Sequence[str], rows: int = 1000) -> list[float]:
    """Means of a few rows, to shift sums by (0 where they have no value)."""
    head = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).limit(rows).agg(*[F.avg(c) for c in cols]).first()
    return [v if v is not None and np.isfinite(v) else 0.0 for v in head]


def moment_table(df: DataFrame, by: Sequence[str], epoch: str, cols: Sequence[str], shift: Sequence[float], patterns: bool = True) -> DataFrame:
    """Rows (by..., epoch, missing, n, sums, products): one pass, one shuffle of partial sums.

    ``missing`` has bit i set where column i is null; ``products`` lists columns i <= j
    row by row.  Both are of the shifted columns, 0 where a value is missing.  Without ``patterns``
    ``missing`` is 0 and a group and epoch is one row.  A task adds up its rows by matrix products and hands on one row per group, epoch and pattern."""
    d, keys = len(cols), [*by, epoch]
    values = df.select(*keys, *cols)   # as they are stored: casts of many columns make a method that the JVM only interprets
    fields = [*values.schema.fields[:len(keys)], T.StructField("missing", T.LongType()), T.StructField("n", T.LongType()),
              T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("products", T.ArrayType(T.DoubleType()))]
    partial = values.mapInArrow(_partial_moments(len(keys), np.array(shift, float), patterns=patterns), T.StructType(fields))
    return partial.groupBy(*keys, "missing").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"),
        F.array(*[F.sum(F.col("products")[i]) for i in range(d * (d + 1) // 2)]).alias("products"))


def _partial_moments(n_keys: int, shift: np.ndarray, most: int = 2000, patterns: bool = True):
    """Task function: batches of (keys..., values...) to partial sums; at most ``most`` groups are held at a time."""
    def partial(batches):
        import numpy as np
        import pyarrow as pa
        d = len(shift)
        upper = np.triu_indices(d)
        held: dict = {}
        form = []

        def rows():
            out = [pa.array([k[i] for k in held], form[i]) for i in range(n_keys)]
            out.append(pa.array([k[-1] for k in held], pa.int64()))
            out.append(pa.array([int(v[0]) for v in held.values()], pa.int64()))
            out.append(pa.array([v[1] for v in held.values()], pa.list_(pa.float64())))
            out.append(pa.array([v[2][upper] for v in held.values()], pa.list_(pa.float64())))
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=[f"k{i}" for i in range(n_keys)] + ["missing", "n", "sums", "products"])

        for batch in batches:
            if not batch.num_rows:
                continue
            form = [batch.column(i).type for i in range(n_keys)]
            names, at, group = [], [], np.zeros(batch.num_rows, np.int64)
            for i in range(n_keys):
                e = batch.column(i).dictionary_encode(null_encoding="encode")
                names.append(e.dictionary.to_pylist())
                at.append(e.indices.to_numpy(zero_copy_only=False))
                group = np.unique(group, return_inverse=True)[1] * len(names[-1]) + at[-1]
            x, missing = np.zeros((batch.num_rows, d)), np.zeros(batch.num_rows, np.int64)
            for i in range(d):
                c = batch.column(n_keys + i).cast(pa.float64(), safe=False)
                x[:, i] = c.fill_null(0.0).to_numpy(zero_copy_only=False) - shift[i]
                if c.null_count:
                    gone = c.is_null().to_numpy(zero_copy_only=False)
                    x[gone, i] = 0.0
                    if patterns:
                        missing[gone] |= 1 << i
            kinds, kind = np.unique(missing, return_inverse=True)
            group = group * len(kinds) + kind
            order = np.argsort(group, kind="stable")
            x, starts = x[order], np.flatnonzero(np.diff(group[order], prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(order)]):
                first, part = order[a], x[a:b]
                key = (*[names[i][at[i][first]] for i in range(n_keys)], int(missing[first]))
                old = held.get(key, (0, 0.0, 0.0))
                held[key] = (old[0] + b - a, old[1] + part.sum(0), old[2] + part.T @ part)
            if len(held) > most:
                yield rows()
        if held:
            yield rows()
    return partial


@dataclass
class Cell:
    """A group's rows of one epoch, missing values filled with the epoch's means."""

    n: float
    seen: np.ndarray    # values there were, per column
    mean: np.ndarray    # nan where a column has no value
    co: np.ndarray      # centred sums of products

    @classmethod
    def of(cls, parts: list[tuple[int, float, list, list]], shift: np.ndarray) -> Cell:
        """From the epoch's patterns (missing, n, sums, products)."""
        d = len(shift)
        here = np.array([[not p[0] >> i & 1 for i in range(d)] for p in parts])
        k = np.array([p[1] for p in parts], float)
        sums = np.array([p[2] for p in parts], float)
        seen = k @ here
        mean = np.divide(sums.sum(0), seen, out=np.full(d, np.nan), where=seen > 0)
        co = np.zeros((d, d))
        upper = np.triu_indices(d)
        for p, h, s, w in zip(parts, here, sums, k):
            own = np.zeros((d, d))
            own[upper] = p[3]
            # about the epoch's mean: sum (x - m)(y - m) over the values there are
            off = np.where(h, s / w - mean, 0.0)
            co += own + np.triu(own, 1).T - np.outer(s, s) / w + w * np.outer(off, off)
        return cls(float(k.sum()), seen, mean + shift, co)


class EpochMoments:
    """Prefix sums over the epochs of each group.

    ``run(group, lo, hi)`` gives the moments of the epochs with lo <= epoch < hi
    (either may be None) from two prefix rows."""

    def __init__(self, cells: dict[tuple, dict[object, Cell]], cols: Sequence[str]):
        self.cols = list(cols)
        self.groups = sorted(cells, key=str)
        self.epochs = {g: sorted(cells[g]) for g in cells}
        self._prefix: dict[tuple, list[dict[str, np.ndarray]]] = {}
        self._centre: dict[tuple, np.ndarray] = {}
        d = len(self.cols)
        for g, by_epoch in cells.items():
            # sums are taken about the mean over all epochs, so that differences of prefix rows stay small numbers
            seen = sum(c.seen for c in by_epoch.values())
            total = sum(np.nan_to_num(c.mean) * c.seen for c in by_epoch.values())
            centre = np.divide(total, seen, out=np.zeros(d), where=seen > 0)
            rows = [{"n": np.zeros(()), "seen": np.zeros(d), "value": np.zeros(d), "first": np.zeros(d), "co": np.zeros((d, d)),
                     "absent": np.zeros(d), "one": np.zeros((d, d)), "none": np.zeros((d, d))}]
            for e in self.epochs[g]:
                c = by_epoch[e]
                there = (c.seen > 0).astype(float)
                m = np.where(there > 0, c.mean - centre, 0.0)
                add = {"n": np.asarray(c.n), "seen": c.seen, "value": c.seen * m, "first": c.n * m, "co": c.co + c.n * np.outer(m, m),
                       "absent": c.n * (1 - there), "one": c.n * np.outer(1 - there, m), "none": c.n * np.outer(1 - there, 1 - there)}
                rows.append({k: rows[-1][k] + v for k, v in add.items()})
            self._prefix[g], self._centre[g] = rows, centre

    @classmethod
    def of(cls, df: DataFrame, by: Sequence[str], epoch: str, cols: Sequence[str], max_rows: int = MAX_ROWS) -> EpochMoments:
        """From the rows of a table; more than ``max_rows`` rows of moments are refused, not cut."""
        if len(cols) > 62:
            raise ValueError("a pattern of missing values has up to 62 columns")
        shift = provisional_means(df, cols)
        rows = moment_table(df, by, epoch, cols, shift).limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} rows of (group, epoch, missing columns): take coarser groups or raise max_rows")
        parts: dict[tuple, dict[object, list]] = {}
        for r in rows:
            parts.setdefault(tuple(r[k] for k in by), {}).setdefault(r[epoch], []).append((r["missing"], float(r["n"]), r["sums"], r["products"]))
        return cls({g: {e: Cell.of(p, np.array(shift)) for e, p in es.items()} for g, es in parts.items()}, cols)

    def run(self, group: tuple, lo=None, hi=None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
        """(n, fill, mean, co) of a run of epochs, None without rows: ``fill`` is what takes the
        place of a missing value of an epoch outside the run, ``co`` is centred."""
        epochs = self.epochs.get(group, [])
        a = 0 if lo is None else sum(e < lo for e in epochs)
        b = len(epochs) if hi is None else sum(e < hi for e in epochs)
        if a >= b:
            return None
        rows = self._prefix[group]
        s = {k: rows[b][k] - rows[a][k] for k in rows[b]}
        n, centre = float(s["n"]), self._centre[group]
        g = np.divide(s["value"], s["seen"], out=-centre.copy(), where=s["seen"] > 0)  # 0 for a column that is never there
        first = s["first"] + s["absent"] * g
        cross = g[:, None] * s["one"]
        second = s["co"] + cross + cross.T + np.outer(g, g) * s["none"]
        mean = first / n
        return n, g + centre, mean + centre, second - n * np.outer(mean, mean)

    def epoch_means(self, group: tuple, feats: Sequence[str]) -> dict[object, np.ndarray]:
        """Means of the features per epoch, nan where a feature has no value there."""
        rows, at = self._prefix[group], [self.cols.index(c) for c in feats]
        out = {}
        for a, b, e in zip(rows, rows[1:], self.epochs[group]):
            seen = (b["seen"] - a["seen"])[at]
            mean = np.divide((b["value"] - a["value"])[at], seen, out=np.full(len(at), np.nan), where=seen > 0)
            out[e] = mean + self._centre[group][at]
        return out

    def fold(self, group: tuple, feats: Sequence[str], targets: Sequence[str], lo=None, hi=None) -> tuple[Moments, np.ndarray] | None:
        """The run's moments as a linear fit reads them, and the fill values of its features."""
        got = self.run(group, lo, hi)
        if got is None:
            return None
        n, fill, mean, co = got
        f, t = [self.cols.index(c) for c in feats], [self.cols.index(c) for c in targets]
        return Moments(n, mean[f], co[np.ix_(f, f)], mean[t], co[np.ix_(f, t)], np.diag(co)[t]), fill[f]


# ML3 -------------------------------------------------------------------------
def independent_columns(co: np.ndarray, tol: float = 1e-8) -> tuple[list[int], list[int]]:
    """Columns of a co-moment matrix that span it, and those that are combinations of them.

    Pivoted Cholesky on the correlations: each step takes the column with the largest
    share of variance not yet explained (ties within 1e-12: the first) and stops when none has
    more than ``tol``.  A constant column is a combination (of none)."""
    d = len(co)
    var = np.clip(np.diag(co), 0.0, None)
    sd = np.sqrt(np.where(var > 1e-12 * max(var.max(initial=0.0), 1e-300), var, np.inf))
    left = np.where(np.isfinite(sd), 1.0, 0.0)
    r = co / np.outer(sd, sd)
    base = np.zeros((d, 0))
    kept: list[int] = []
    while len(kept) < d:
        rest = left.copy()
        rest[kept] = -1.0
        p = int(np.flatnonzero(rest >= rest.max() - 1e-12)[0])
        if rest[p] <= tol:
            break
        col = (r[:, p] - base @ base[p]) / np.sqrt(left[p])
        base = np.column_stack([base, col])
        left = np.clip(left - col ** 2, 0.0, None)
        kept.append(p)
    return sorted(kept), [i for i in range(d) if i not in kept]


# ML4 / ML5 / ML17 ----------------------------------------------------------------
def elastic_net(zz: np.ndarray, zy: np.ndarray, n: float, alpha: float, l1_ratio: float, start: np.ndarray | None = None,
                max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """Minimise ``|y - Zb|^2 / 2n + alpha * (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2)`` by
    coordinate descent on Z'Z and Z'y alone; ``start`` warm-starts a path of alphas."""
    a, c = zz / n, zy / n
    b = np.zeros(len(c)) if start is None else start.copy()
    grad = c - a @ b
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        most = 0.0
        for j in range(len(b)):
            if a[j, j] + l2 <= 0.0:
                continue
            rho = grad[j] + a[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (a[j, j] + l2)
            step = new - b[j]
            if step:
                grad -= a[:, j] * step
                b[j] = new
                most = max(most, abs(step))
        if most <= tol * max(1.0, np.abs(b).max(initial=0.0)):
            break
    return b
