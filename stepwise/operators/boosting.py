"""Gradient boosting for all groups of a table at once (ML13).

The rules are those of Spark's ``GBTRegressor`` with squared loss: the first tree is fitted to the target,
each later one to twice what is left of it and added with the step size; up to 32 bins a feature, all
features tried, the split that lowers the variance most.  Rows are binned and packed once; each level of
the groups' next trees is one pass over them.  Tasks add up histograms and the driver gets one for each
task; what the last few trees leave of a target is worked out in the pass and packed again now and then.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators import forest as FO

ROWS_PER_TASK = 2_000_000   # packed rows that one task counts; the number of tasks follows the rows
TREES_A_PACKING = 6         # trees after which what is left of the targets is packed again


def _left(trees: dict, n_feats: int):
    """What tasks share: of a packed value the bins, the rows as one number each, and what the trees since the
    last packing leave of its targets."""
    _, words, tables, walk, _ = FO._tasks()
    ready: dict = {}

    def left(g, n, data):
        import numpy as np
        if g not in ready:
            ready[g] = tables(trees[g][0], n_feats) if trees[g][0] else None
        levels, values = trees[g]
        y = np.frombuffer(data, float, n).copy()
        bins = np.frombuffer(data, np.uint8, n * n_feats, 8 * n).reshape(n_feats, n)
        part = 65_536   # rows whose numbers stay near the processor
        for lo in range(0, n, part):
            own = np.ascontiguousarray(bins[:, lo:lo + part])
            word, m = words(own), own.shape[1]
            rest, rows, flat = y[lo:lo + part], np.arange(m), own.ravel()
            for t in range(len(values)):
                rest -= values[t].take(walk(levels, t, flat, m, rows, word, ready[g]))
            yield own, word, rows, rest
    return left


def _histograms(trees: dict, growing: dict, n_feats: int, n_bins: int):
    """Task function: packed rows to rows (g, data), the sums of rows and of what is left of their targets by feature,
    sum, node of the growing tree and bin."""
    left = _left(trees, n_feats)
    _, _, tables, walk, _ = FO._tasks()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        sums: dict = {}
        for batch in batches:
            for g, n, data in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
                levels = growing[g]
                size = n_bins << len(levels)
                if g not in sums:
                    sums[g] = np.zeros((n_feats, 2, size)), tables(levels, n_feats)
                total, table = sums[g]
                for bins, word, rows, rest in left(g, n, data.as_buffer()):
                    first = walk(levels, 0, bins.ravel(), len(rows), rows, word, table) * n_bins
                    for f in range(n_feats):
                        cell = bins[f].astype(np.intp)
                        cell += first
                        total[f, 0] += np.bincount(cell, minlength=size)
                        total[f, 1] += np.bincount(cell, rest, size)
        for g, (total, _) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "data"])
    return run


def _packed_again(trees: dict, n_feats: int):
    """Task function: packed rows with what the trees leave of their targets in the place of these."""
    left = _left(trees, n_feats)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for g, n, data in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
                data = data.as_buffer()
                rest = np.concatenate([r for *_, r in left(g, n, data)])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([n], pa.int32()), pa.array([rest.tobytes() + bytes(data[8 * n:])], pa.binary())],
                                                 names=["g", "n", "data"])
    return run


def fit_boosting(rows: DataFrame, keys: Sequence[str], feats: Sequence[str], target: str, trees: int = 100, depth: int = 4,
                 lr: float = 0.1) -> dict[tuple, FO.Forest]:
    """The boosted trees of each group of ``keys`` as a forest whose mean is their sum.  Rows without a target or a
    key are left out."""
    import pyarrow as pa
    known = rows.where(F.col(target).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    known = known.select(*keys, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in feats])
    shape = FO.group_quantiles(known, keys, feats)
    groups = list(shape)
    if not groups:
        return {}
    thrs, tasks, slots = FO.layout(shape, ROWS_PER_TASK)
    d = len(feats)
    packed = known.mapInArrow(FO._pack({g: i for i, g in enumerate(groups)}, thrs, tasks, len(keys), FO.ROWS_PER_PIECE, hashed=False), "g int, slot int, n int, data binary")
    packed = packed.repartitionById(slots, F.col("slot")).select("g", "n", "data").persist(StorageLevel.DISK_ONLY)   # read in every pass
    done: list[list[FO.Forest]] = [[] for _ in groups]
    old, fresh = None, 0

    def stacked(g, last):
        """The last trees of a group, their values as they are added up."""
        some = done[g][len(done[g]) - last:] if last else []
        return ([tuple(np.concatenate([f.levels[k][i] for f in some]) for i in (0, 1)) for k in range(depth)] if some else [],
                np.concatenate([f.values for f in some]) if some else np.zeros((0, 1)))

    try:
        for m in range(trees):
            grown = [FO.Forest(t, [], np.zeros((1, 1)), np.ones((1, 1), bool)) for t in thrs]
            if fresh == TREES_A_PACKING:
                old, packed = packed, packed.mapInArrow(_packed_again({g: stacked(g, fresh) for g in range(len(groups))}, d), "g int, n int, data binary").persist(StorageLevel.DISK_ONLY)
                fresh = 0
            since = {g: stacked(g, fresh) for g in range(len(groups))}
            for level in range(depth):
                sums: dict = {}
                # a histogram per task
                for r in packed.mapInArrow(_histograms(since, {g: f.levels for g, f in enumerate(grown)}, d, FO.BINS), "g int, data binary").collect():
                    sums[r["g"]] = sums.get(r["g"], 0.0) + np.frombuffer(r["data"], float)
                best = FO._best_splits(np.tile(np.arange(d), (1, 2 ** level, 1)), FO.BINS, FO.TREES_PER_ROW)
                FO._grow(grown, level, {(g, 0): best(pa.table({"g": [g], "chunk": [0], "data": pa.array([s.tobytes()], pa.binary())})).column("best")[0].as_py() for g, s in sums.items()}, 1)
                if old is not None:
                    old, _ = None, old.unpersist()
            for g, f in enumerate(grown):
                f.values = f.values * (2 * lr if m else 1.0)
                done[g].append(f)
            fresh += 1
    finally:
        packed.unpersist()
        if old is not None:
            old.unpersist()
    out = {}
    for g, key in enumerate(groups):
        levels, values = stacked(g, trees)
        out[key] = FO.Forest(thrs[g], levels, values * trees, np.zeros((trees, 1), bool))
    return out
