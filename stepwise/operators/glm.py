"""Poisson regression with log link (ML7) and logistic regression (ML14) for all groups of a table at once.

Iteratively reweighted least squares as Spark's ``GeneralizedLinearRegression`` does it:
the same start, the same penalty and the same stop.  Rows are packed once; each iteration
reads them once for all groups that have not converged.  Tasks add up weighted cross
products, and one small matrix per group reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.operators.moments import provisional_means
from stepwise.session import write_and_reload

LEAST_MEAN = 1e-16   # Spark's bounds of a fitted mean
MOST_MEAN = float(np.finfo(float).max)
BYTES_PER_TASK = 16 << 20   # packed rows that a task of the logistic regression reads


#: A row's key to the groups it serves in, each with what fills the row's missing values there (None: nothing is missing).
Serves = dict[tuple, list[tuple[tuple, np.ndarray | None]]]


def _pack(n_keys: int):
    """Task function: batches of (keys..., y, x...) to rows (keys..., data), the numbers of a batch's rows of one key
    as bytes (missing: nan).  They reach later tasks as they are; number by number, rows cost far more than the fit."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at, code = [], [], np.zeros(batch.num_rows, np.int64)
            for i in range(n_keys):
                e = batch.column(i).dictionary_encode(null_encoding="encode")
                names.append(e.dictionary.to_pylist())
                at.append(e.indices.to_numpy(zero_copy_only=False))
                code = code * len(names[-1]) + at[-1]
            values = np.column_stack([c.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]])
            runs = [np.flatnonzero(code == k) for k in np.unique(code)]
            out = [pa.array([names[i][at[i][r[0]]] for r in runs], batch.column(i).type) for i in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*out, pa.array([values[r].tobytes() for r in runs], pa.binary())], names=[*batch.schema.names[:n_keys], "data"])
    return run


def _cross_products(n_keys: int, serves: Serves, shifts: dict[tuple, float], centre: np.ndarray, betas: dict[tuple, np.ndarray] | None):
    """Task function: packed rows to rows (group, m), the number of a group and the upper triangle of its
    ``sum w (1, x, v)(1, x, v)'``, where v is the working label and w its weight."""
    least, most = LEAST_MEAN, MOST_MEAN   # a task gets what it needs by value
    number = {g: i for i, g in enumerate(shifts)}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        d = len(centre)
        upper = np.triu_indices(d + 2)
        sums: dict = {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
            for key, data in zip(keys, batch.column(n_keys)):
                values = np.frombuffer(data.as_buffer(), float).reshape(-1, d + 1)
                for group, fill in serves.get(key, ()):
                    if betas is not None and group not in betas:
                        continue
                    x = values[:, 1:]
                    label, z = values[:, 0] + shifts[group], np.ones((len(values), d + 2))
                    z[:, 1:-1] = (x if fill is None else np.where(np.isnan(x), fill, x)) - centre
                    if betas is None:
                        z[:, -1] = np.log(np.maximum(label, 0.1))
                        weighted = z
                    else:
                        with np.errstate(over="ignore"):
                            eta = z[:, :-1] @ betas[group]
                            mu = np.clip(np.exp(eta), least, most)
                        z[:, -1] = eta + (label - mu) / mu
                        weighted = z * mu[:, None]
                    sums[group] = sums.get(group, 0.0) + weighted.T @ z
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([number[g] for g in sums], pa.int32()), pa.array([m[upper] for m in sums.values()], pa.list_(pa.float64()))],
                                             names=["group", "m"])
    return run


def _solve(m: np.ndarray, alpha: float, standardise: bool) -> np.ndarray:
    """(intercept, weights) of a penalised weighted least squares fit from its cross products.

    The start is penalised on the standardised scale, each iteration on the raw one."""
    total = m[0, 0]
    mean = m[0, 1:] / total
    co = m[1:, 1:] / total - np.outer(mean, mean)
    var, out = np.diag(co), np.zeros(len(m) - 1)
    use = np.flatnonzero(var[:-1] > 1e-13 * np.diag(m)[1:-1] / total)   # a constant column weighs 0
    if var[-1] > 0 and len(use):
        sd = np.sqrt(var[use])
        penalty = alpha / np.sqrt(var[-1]) if standardise else alpha / var[use]
        a = co[np.ix_(use, use)] / np.outer(sd, sd) + penalty * np.eye(len(use))
        out[1 + use] = np.linalg.lstsq(a, co[use, -1] / sd, rcond=None)[0] / sd
    out[0] = mean[-1] - mean[:-1] @ out[1:]
    return out


def fit_poisson(rows: DataFrame, keys: Sequence[str], feats: Sequence[str], target: str, alpha: float = 1e-4,
                max_iter: int = 100, tol: float = 1e-6, serves: Serves | None = None) -> dict[tuple, tuple[float, list[float], float]]:
    """(offset, w, shift) per group: log(mean of target + shift) = offset + w x.

    ``serves`` tells by a row's ``keys`` the groups it serves in; by default the keys are
    the group and no feature is missing.  Rows without a target or a key are left out.
    The target is shifted by ``max(0, 1 - min)`` of its group."""
    known = rows.where(F.col(target).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    lows = {tuple(r[k] for k in keys): r["m"] for r in known.groupBy(*keys).agg(F.min(F.col(target).cast("double")).alias("m")).collect()}   # one row per key
    if serves is None:
        serves = {k: [(k, None)] for k in lows}
    shifts: dict[tuple, float] = {}
    for k, low in lows.items():
        for group, _ in serves.get(k, ()):
            shifts[group] = max(shifts.get(group, 0.0), 1.0 - low)
    centre = np.array(provisional_means(known, feats))
    known = known.select(*keys, target, *feats)
    packed = write_and_reload(known.mapInArrow(_pack(len(keys)), T.StructType([*known.schema.fields[:len(keys)], T.StructField("data", T.BinaryType())])), "glm-rows")
    upper = np.triu_indices(len(feats) + 2)

    def cross(betas):
        sums = packed.mapInArrow(_cross_products(len(keys), serves, shifts, centre, betas), "group int, m array<double>").select("group", F.posexplode("m"))
        out: dict[tuple, np.ndarray] = {}
        groups = list(shifts)
        for r in sums.groupBy("group", "pos").agg(F.sum("col").alias("s")).collect():   # a matrix of the features per group
            m = out.setdefault(groups[r["group"]], np.zeros((len(feats) + 2,) * 2))
            i, j = upper[0][r["pos"]], upper[1][r["pos"]]
            m[i, j] = m[j, i] = r["s"]
        return out

    def raw(b):
        return np.append(b[1:], b[0] - b[1:] @ centre)

    fits = {g: _solve(m, alpha, True) for g, m in cross(None).items()} if shifts else {}
    moving = dict(fits)
    for _ in range(max_iter):
        if not moving:
            break
        new = {g: _solve(m, alpha, False) for g, m in cross(moving).items()}
        moving = {g: b for g, b in new.items() if not np.abs(raw(b) - raw(fits[g])).max() < tol}
        fits |= new
    return {g: (float(raw(b)[-1]), b[1:].tolist(), shifts[g]) for g, b in fits.items()}


def _logistic_sums(n_keys: int, betas: dict[tuple, np.ndarray], centre: np.ndarray):
    """Task function: packed rows to rows (group, m), the number of a group with, of its log loss, the second derivatives'
    upper triangle, the first derivatives and the loss itself."""
    number = {g: i for i, g in enumerate(betas)}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        d = len(centre)
        upper = np.triu_indices(d + 1)
        sums: dict = {}
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(n_keys)))
            for key, data in zip(keys, batch.column(n_keys)):
                if key not in betas:
                    continue
                values = np.frombuffer(data.as_buffer(), float).reshape(-1, d + 1)
                z = np.ones((len(values), d + 1))
                z[:, 1:] = values[:, 1:] - centre
                eta, label = z @ betas[key], values[:, 0]
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-eta))
                second = (z * (p * (1.0 - p))[:, None]).T @ z
                sums[key] = sums.get(key, 0.0) + np.concatenate([second[upper], (p - label) @ z, [(np.logaddexp(0.0, eta) - label * eta).sum()]])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([number[g] for g in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["group", "m"])
    return run


def fit_logistic(rows: DataFrame, keys: Sequence[str], feats: Sequence[str], target: str, max_iter: int = 100, tol: float = 1e-11,
                 n_rows: int | None = None) -> dict[tuple, tuple[float, list[float]]]:
    """(offset, w) per group: log(p / (1 - p)) = offset + w x, the least of the log loss plus |w|^2 / 2.

    That is Spark's ``LogisticRegression`` with ``regParam`` 1 / rows and no standardisation, by Newton steps, halved
    where one does not lower the loss, to the minimum itself.  ``target`` is 0 or 1.  Rows are packed once and read once
    a step for all groups that have not converged; rows without a target or a key are left out."""
    known = rows.where(F.col(target).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    centre = np.array(provisional_means(known, feats))
    known = known.select(*keys, target, *feats)
    packed = known.mapInArrow(_pack(len(keys)), T.StructType([*known.schema.fields[:len(keys)], T.StructField("data", T.BinaryType())]))
    # packed values of a task travel to Python in few large batches, so a task gets so many bytes, however large the table;
    # they are kept on disk, as a Parquet reader holds some thousand of them in the heap
    tasks = max(1, -(-(known.count() if n_rows is None else n_rows) * (len(feats) + 1) * 8 // BYTES_PER_TASK))
    packed = packed.repartitionById(tasks, F.pmod(F.xxhash64("data"), F.lit(tasks)).cast("int")).persist(StorageLevel.DISK_ONLY)
    try:
        fits = _newton(packed, keys, centre, max_iter, tol)
    finally:
        packed.unpersist()
    return {g: (float(b[0] - b[1:] @ centre), b[1:].tolist()) for g, b in fits.items()}


def _newton(packed: DataFrame, keys: Sequence[str], centre: np.ndarray, max_iter: int, tol: float) -> dict[tuple, np.ndarray]:
    """Offset and weights of the centred features per group of packed rows."""
    n = len(centre) + 1
    upper = np.triu_indices(n)
    ridge = np.diag([0.0, *np.ones(n - 1)])

    def sums(betas):
        got = packed.mapInArrow(_logistic_sums(len(keys), betas, centre), "group int, m array<double>").select("group", F.posexplode("m"))
        groups, out = list(betas), {g: np.zeros(len(upper[0]) + n + 1) for g in betas}
        for r in got.groupBy("group", "pos").agg(F.sum("col").alias("s")).collect():   # a matrix of the features per group
            out[groups[r["group"]]][r["pos"]] = r["s"]
        return out

    # one row per group
    moving = {tuple(r[k] for k in keys): np.zeros(n) for r in packed.select(*keys).distinct().collect()}
    fits: dict[tuple, np.ndarray] = {}
    best: dict[tuple, tuple] = {}   # loss, coefficients and step of the last point that lowered the loss
    for _ in range(max_iter):
        if not moving:
            break
        for g, m in sums(moving).items():
            beta = moving[g]
            loss = m[-1] + beta @ ridge @ beta / 2
            if g in best and not loss <= best[g][0] * (1 + 1e-12):
                best[g] = (*best[g][:2], best[g][2] / 2)
                moving[g] = best[g][1] - best[g][2]
                if np.abs(best[g][2]).max() < 1e-12:
                    fits[g] = best[g][1]
                    del moving[g]
                continue
            second = np.zeros((n, n))
            second[upper] = m[:len(upper[0])]
            second = second + np.triu(second, 1).T + ridge
            first = m[len(upper[0]):-1] + ridge @ beta
            step = np.linalg.lstsq(second, first, rcond=None)[0]
            best[g] = loss, beta, step
            moving[g] = beta - step
            if first @ step <= tol * loss:   # the next step would be some of this one squared
                fits[g] = moving.pop(g)
    return fits | {g: b for g, (_, b, _) in best.items() if g in moving}


def fitted_mean(eta: Column, shift: Column) -> Column:
    """The mean of the target, from the linear predictor and its group's shift."""
    return F.least(F.greatest(F.exp(eta), F.lit(LEAST_MEAN)), F.lit(MOST_MEAN)) - shift
