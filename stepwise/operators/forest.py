"""Random forests for all groups of a table at once (ML12).

The rules are those of Spark's ``RandomForestRegressor``: Poisson(1) bags, up to 32 bins a
feature, a third of the features tried at a node, the split that lowers the variance most,
the mean of the trees.  Rows are binned and packed once and read once for each level of all
trees of all groups.  Tasks add up histograms, which Spark brings together by group and
trees; the driver gets the chosen splits.  A row's weight in a tree follows from its key, so
a forest does not depend on how the rows lie in partitions; rows of equal keys weigh the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 32                 # Spark's maxBins
QUANTILES = 2000          # points of a feature's distribution that its thresholds are set from
TREES_PER_ROW = 10        # trees whose histograms travel in one row
ROWS_PER_PIECE = 65_536   # packed rows in one value
HELD = 16_384             # values of a feature that a task holds of a group before it keeps every second one of them
HANDED = 8_192            # points at even ranks that it hands on of a feature with more values
ROWS_PER_TASK = 500_000   # packed rows that one task counts; the number of tasks follows the rows


@dataclass
class Forest:
    """Trees of one group: a feature's thresholds; per level the nodes' features and bins (trees x nodes),
    a row going left if its bin is not above; the leaves' values."""
    thresholds: list[np.ndarray]
    levels: list[tuple[np.ndarray, np.ndarray]]
    values: np.ndarray
    active: np.ndarray


def thresholds(quantiles: Sequence[float], n: int) -> np.ndarray:
    """Up to 31 thresholds, each half way between neighbouring values, by Spark's rule."""
    values, counts = np.unique(np.asarray(quantiles, float), return_counts=True)
    middles = (values[:-1] + values[1:]) / 2
    bins = min(BINS, n)
    if len(middles) < bins:
        return middles
    stride = counts.sum() / bins
    out, target, below = [], stride, counts[0]
    for i in range(1, len(values)):
        if abs(below - target) < abs(below + counts[i] - target):
            out.append(middles[i - 1])
            target += stride
        below += counts[i]
    return np.array(out[:bins - 1])


def _tasks():
    """What tasks share, made here so that they get it by value."""
    def binned(thrs, x):
        """Bins of the rows ``x`` (rows x features), a line per feature."""
        import numpy as np
        return np.stack([np.searchsorted(t, x[:, i]) for i, t in enumerate(thrs)]).astype(np.uint8)

    def words(bins):
        """The bins of each row as one number, five bits a feature; None for more than 12 features."""
        import numpy as np
        if len(bins) > 12:
            return None
        kind = np.uint32 if len(bins) <= 6 else np.uint64
        out = np.zeros(bins.shape[1], kind)
        for i, b in enumerate(bins):
            out |= b.astype(kind) << kind(5 * i)
        return out

    def tables(levels, n_feats):
        """For every tree and pair of features, by the pair's bins, the leaves that the pair's nodes leave open, a bit
        a leaf: a node whose row goes right closes the leaves on its left.  None for more than 64 leaves."""
        import numpy as np
        if not 2 <= len(levels) <= 6 or n_feats > 12:
            return None
        leaves, kind = 2 ** len(levels), np.uint32 if len(levels) <= 5 else np.uint64
        n_trees = len(levels[0][0])
        open_, trees = np.full((n_trees, n_feats + n_feats % 2, 32), ~kind(0)), np.arange(n_trees)
        for level, (feats, cuts) in enumerate(levels):
            width = leaves >> level
            for k in range(1 << level):
                left = kind(((1 << width // 2) - 1) << k * width)
                right = np.arange(32) > cuts[:, k, None]
                open_[trees, feats[:, k]] &= np.where(right, ~left, ~kind(0))
        pairs = open_[:, 1::2, :, None] & open_[:, ::2, None, :]
        return pairs.reshape(n_trees, -1, 1024)

    def walk(levels, tree, flat, n, rows, word=None, table=None):
        """Each row's node of a tree below the given levels; ``flat`` are the bins of ``n`` rows, feature by feature,
        ``word`` the rows' bins as one number and ``table`` what :func:`tables` gives.  The node is the first leaf left open."""
        import numpy as np
        if not levels:
            return np.zeros(len(rows), np.intp)
        if word is not None and len(levels) == 1:
            (feats, cuts), kind = levels[0], word.dtype.type
            return ((word >> kind(5 * int(feats[tree, 0])) & kind(31)) > cuts[tree, 0]).astype(np.intp)
        if word is not None and table is not None:
            kind = word.dtype.type
            left = table[tree, 0].take(word & kind(1023), mode="wrap")
            for i in range(1, table.shape[1]):
                left &= table[tree, i].take(word >> kind(10 * i) & kind(1023), mode="wrap")
            return np.bitwise_count((left & -left) - left.dtype.type(1)).astype(np.intp)
        node = np.zeros(len(rows), np.intp)
        for feats, bins in levels:
            at = (feats[tree].astype(np.intp) * n).take(node)
            at += rows
            right = flat.take(at) > bins[tree].take(node)
            node <<= 1
            node += right
        return node

    def numbers(columns, number):
        """The number of each row's group, -1 for a group that has none."""
        import numpy as np
        code, names = np.zeros(len(columns[0]), np.int64), [()]
        for c in columns:
            e = c.dictionary_encode(null_encoding="encode")
            code = code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
            names = [(*n, v) for n in names for v in e.dictionary.to_pylist()]
        return np.array([number.get(n, -1) for n in names])[code]
    return binned, words, tables, walk, numbers


def _sketch(n_keys: int, form: list, held: int, handed: int):
    """Task function: batches of (keys..., x...) to rows (keys..., feature, n, values, weights) that stand for a group's
    values of a feature, by number, and its row count as feature -1.  All values are kept up to ``held`` of them; a full
    level of values is sorted and every second one goes a level up, where it stands for twice as many."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        counts: dict = {}
        levels: dict = {}
        turns: dict = {}

        def add(k, values, level=0):
            own = levels.setdefault(k, [])
            while len(own) <= level:
                own.append([])
            own[level].append(values)
            if sum(map(len, own[level])) >= held:
                v = np.sort(np.concatenate(own[level]))
                even = len(v) // 2 * 2
                own[level] = [v[even:]]
                turns[k, level] = turn = 1 - turns.get((k, level), 1)
                add(k, v[turn:even:2], level + 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            code, names = np.zeros(batch.num_rows, np.int64), [()]
            for c in batch.columns[:n_keys]:
                e = c.dictionary_encode(null_encoding="encode")
                code = code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
                names = [(*n, v) for n in names for v in e.dictionary.to_pylist()]
            x = [(c.is_valid().to_numpy(zero_copy_only=False), c.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False))
                 for c in batch.columns[n_keys:]]
            for i in np.unique(code):
                here = code == i
                counts[names[i]] = counts.get(names[i], 0) + int(here.sum())
                for f, (known, v) in enumerate(x):
                    add((names[i], f), v[here & known])

        def rows():
            for key, n in counts.items():
                yield (*key, -1, n, b"", b"")
                for f in range(len(x)):
                    parts = [(np.concatenate(a), 2.0 ** level) for level, a in enumerate(levels[key, f]) if a]
                    v = np.concatenate([a for a, _ in parts])
                    w = np.concatenate([np.full(len(a), weight) for a, weight in parts])
                    if len(v) > held:
                        order = np.argsort(v, kind="stable")
                        v, upto = v[order], np.cumsum(w[order])
                        v = v[np.searchsorted(upto, (np.arange(handed) + 0.5) / handed * upto[-1])]
                        w = np.full(handed, upto[-1] / handed)
                    yield (*key, f, int(w.sum().round()), v.tobytes(), w.tobytes())
        kinds = [*form, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for row in rows():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[*[f"k{i}" for i in range(n_keys)], "feature", "n", "values", "weights"])
    return run


def _quantiles(n_keys: int, form: list, points: int):
    """Group function: what tasks tell of a feature to the values at ``points`` even ranks; of feature -1 to the row count."""
    def run(table):
        import numpy as np
        import pyarrow as pa
        v = np.concatenate([np.frombuffer(b.as_buffer(), float) for b in table.column("values")])
        w = np.concatenate([np.frombuffer(b.as_buffer(), float) for b in table.column("weights")])
        order = np.argsort(v, kind="stable")
        v, upto = v[order], np.cumsum(w[order])
        at = []
        if len(v):
            rank = np.ceil((np.arange(points) + 0.5) / points * round(upto[-1]))
            at = v[np.minimum(np.searchsorted(upto, rank - 1e-6), len(v) - 1)]
        n = sum(table.column("n").to_pylist())
        return pa.table([*[pa.array([table.column(i)[0].as_py()], t) for i, t in enumerate(form)], pa.array([table.column("feature")[0].as_py()], pa.int32()),
                         pa.array([n], pa.int64()), pa.array([at], pa.list_(pa.float64()))], names=[*table.schema.names[:n_keys], "feature", "n", "points"])
    return run


def group_quantiles(rows: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> dict[tuple, tuple[int, list]]:
    """Per group its row count and the values of each feature at QUANTILES even ranks.  Tasks sum the values up in numpy,
    in bounded memory; the ranks are exact up to HELD values a task, and less than a thousandth off beyond."""
    from pyspark.sql.pandas.types import to_arrow_type
    values = rows.select(*keys, *feats)
    fields = values.schema.fields[:len(keys)]
    form = [to_arrow_type(f.dataType) for f in fields]
    named = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]
    numbers = [T.StructField("feature", T.IntegerType()), T.StructField("n", T.LongType())]
    sketch = values.mapInArrow(_sketch(len(keys), form, HELD, HANDED), T.StructType([*named, *numbers, T.StructField("values", T.BinaryType()), T.StructField("weights", T.BinaryType())]))
    by = [f.name for f in named]
    # a count and QUANTILES numbers a feature for each group
    got = sketch.groupBy(*by, "feature").applyInArrow(_quantiles(len(keys), form, QUANTILES), T.StructType([*named, *numbers, T.StructField("points", T.ArrayType(T.DoubleType()))])).collect()
    out = {tuple(r[k] for k in by): (r["n"], [None] * len(feats)) for r in got if r["feature"] < 0}
    for r in got:
        if r["feature"] >= 0:
            out[tuple(r[k] for k in by)][1][r["feature"]] = r["points"]
    return out


def _pack(number: dict, thrs: list, tasks: list[tuple[int, int]], n_keys: int, per_piece: int, hashed: bool = True):
    """Task function: batches of (keys..., hash, y, x...) to rows (g, slot, n, data) of a group's binned rows as bytes.
    Without ``hashed`` there is no hash."""
    binned, *_, numbers = _tasks()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        turn = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}
        sent = dict.fromkeys(range(len(thrs)), turn)

        def piece(g):
            h, y, b = (np.concatenate(a, axis=-1) for a in zip(*waiting.pop(g)))
            first, n_tasks = tasks[g]
            sent[g] += 1
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([first + sent[g] % n_tasks], pa.int32()), pa.array([len(y)], pa.int32()),
                                               pa.array([h.tobytes() + y.tobytes() + b.tobytes()], pa.binary())], names=["g", "slot", "n", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = numbers(batch.columns[:n_keys], number)
            h = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if hashed else None
            y, *x = (c.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + hashed:])
            x = np.column_stack(x)
            for k in np.unique(g[g >= 0]):
                at = np.flatnonzero(g == k)
                waiting.setdefault(int(k), []).append((h[at] if hashed else np.empty(0), y[at], binned(thrs[k], x[at])))
                if sum(len(w[1]) for w in waiting[int(k)]) >= per_piece:
                    yield piece(int(k))
        for k in list(waiting):
            yield piece(k)
    return run


def _histograms(levels: dict, tried: np.ndarray, salts: np.ndarray, poisson: np.ndarray, n_feats: int, n_bins: int, per_row: int):
    """Task function: packed rows to rows (g, chunk, data), for some trees the sums of weight and of
    weight times target by tree, node, tried feature and bin."""
    _, words, tables, walk, _ = _tasks()

    def whole(y, m):
        """A power of two above twice any sum of weighted targets, whose multiples stay exact; 0 where there is none."""
        import numpy as np
        if not m or not np.all(y == np.rint(y)):
            return 0.0
        most = m * float(poisson.max())
        unit = 2.0 ** np.ceil(np.log2(2 * most * max(1.0, np.abs(y).max()) + 2))
        return unit if unit * (most + 1) < 2.0 ** 53 else 0.0

    def run(batches):
        import numpy as np
        import pyarrow as pa
        n_trees, n_nodes, n_tried = tried.shape
        size = n_nodes * n_bins
        sums: dict = {}
        for batch in batches:
            for g, n, data in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
                data = data.as_buffer()
                h, y = np.frombuffer(data, np.uint64, n), np.frombuffer(data, float, n, 8 * n)
                bins = np.frombuffer(data, np.uint8, n * n_feats, 16 * n)
                if g not in sums:
                    sums[g] = np.zeros((n_trees, n_tried, 2, size)), tables(levels[g], n_feats)
                total, table = sums[g]
                part = 65_536   # rows whose numbers stay near the processor
                for lo in range(0, n, part):
                    hp, yp = h[lo:lo + part], y[lo:lo + part]
                    m = len(yp)
                    flat = np.ascontiguousarray(bins.reshape(n_feats, n)[:, lo:lo + part])
                    word, flat = words(flat), flat.ravel()
                    # whole numbers that are not too large: one sum holds both, the weights above the weighted targets
                    unit = whole(yp, m)
                    both = yp + unit
                    draw = np.empty(m, np.uint64)
                    for t in range(n_trees):
                        np.bitwise_xor(hp, salts[t, 0], out=draw)
                        np.multiply(draw, salts[t, 1], out=draw)
                        np.right_shift(draw, np.uint64(48), out=draw)
                        weights = poisson.take(draw.view(np.int64), mode="wrap")
                        rows = np.flatnonzero(weights > 0)
                        w = weights.take(rows, mode="wrap").astype(float)
                        wy = w * both.take(rows, mode="wrap")
                        own = None if word is None else word.take(rows, mode="wrap")
                        node = walk(levels[g], t, flat, m, rows, own, table)
                        first = node * n_bins
                        for j in range(n_tried):
                            if own is None:
                                at = (tried[t, :, j] * m).take(node)
                                at += rows
                                cell = first + flat.take(at)
                            elif len(tried[t]) == 1:
                                cell = (own >> own.dtype.type(5 * int(tried[t, 0, j])) & own.dtype.type(31)).astype(np.intp)
                            else:
                                cell = own >> (5 * tried[t, :, j]).astype(own.dtype).take(node, mode="wrap") & own.dtype.type(31)
                                cell = cell.astype(np.intp)
                                cell += first
                            second = np.bincount(cell, wy, size)
                            if unit:
                                count = np.rint(second / unit)
                                second = second - count * unit
                            else:
                                count = np.bincount(cell, w, size)
                            total[t, j, 0] += count
                            total[t, j, 1] += second
        for g, (total, _) in sums.items():
            starts = range(0, n_trees, per_row)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(starts), pa.int32()), pa.array(list(starts), pa.int32()),
                                              pa.array([total[s:s + per_row].tobytes() for s in starts], pa.binary())], names=["g", "chunk", "data"])
    return run


def _best_splits(tried: np.ndarray, n_bins: int, per_row: int):
    """Group function: histograms of some trees of a group to the best split of each node as bytes: feature, bin
    (255: no split), then weight and weighted target on the left and on the right."""
    def run(table):
        import numpy as np
        import pyarrow as pa
        g, chunk = table.column("g")[0].as_py(), table.column("chunk")[0].as_py()
        feats = tried[chunk:chunk + per_row]
        n_trees, n_nodes, n_tried = feats.shape
        sums = sum(np.frombuffer(d.as_buffer(), float) for d in table.column("data"))
        sums = sums.reshape(n_trees, n_tried, 2, n_nodes, n_bins).transpose(0, 3, 2, 1, 4)   # trees, nodes, sum, tried, bin
        left = np.cumsum(sums, axis=-1)
        both = left[..., -1:]
        right = both - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, :, 1] ** 2 / left[:, :, 0] + right[:, :, 1] ** 2 / right[:, :, 0]
            whole = (both[:, :, 1] ** 2 / both[:, :, 0])[:, :, :1]
        gain = np.where((left[:, :, 0] > 0) & (right[:, :, 0] > 0), gain - whole, -np.inf)
        best = gain.reshape(n_trees, n_nodes, -1).argmax(-1)
        j, b = best // n_bins, best % n_bins
        i, k = np.ogrid[:n_trees, :n_nodes]
        # a gain that is only rounding is none
        splits = gain[i, k, j, b] > 1e-12 * np.nan_to_num(whole[:, :, 0, 0])
        out = np.stack([feats[i, k, j], np.where(splits, b, 255), left[i, k, 0, j, b], left[i, k, 1, j, b], right[i, k, 0, j, b], right[i, k, 1, j, b]]).astype(float)
        return pa.table({"g": pa.array([g], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "best": pa.array([out.tobytes()], pa.binary())})
    return run


def layout(shape: dict, per_task: int) -> tuple[list, list[tuple[int, int]], int]:
    """From what :func:`group_quantiles` tells: each group's thresholds, its first task and number of tasks, and all tasks."""
    thrs = [[thresholds(q or [], n) for q in by_feature] for n, by_feature in shape.values()]
    tasks, slots = [], 0
    for n, _ in shape.values():
        tasks.append((slots, -(-n // per_task)))
        slots += tasks[-1][1]
    return thrs, tasks, slots


def fit_forests(rows: DataFrame, keys: Sequence[str], row_key: Sequence[str], feats: Sequence[str], target: str,
                trees: int = 200, depth: int = 6, seed: int = 42) -> dict[tuple, Forest]:
    """One forest per group of ``keys``.  ``row_key`` tells rows apart, for their bags.  Rows without a
    target or a key are left out."""
    known = rows.where(F.col(target).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    x = [F.col(f).cast("double").alias(f) for f in feats]
    known = known.select(*keys, F.xxhash64(*row_key).alias("_h"), F.col(target).cast("double").alias("_y"), *x)
    shape = group_quantiles(known, keys, feats)
    groups = list(shape)
    if not groups:
        return {}
    thrs, tasks, slots = layout(shape, ROWS_PER_TASK)
    rng = np.random.default_rng(seed)
    salts = rng.integers(0, 2 ** 64, (trees, 2), dtype=np.uint64) | np.array([0, 1], np.uint64)
    # the weight for each 16-bit number: Poisson(1)
    ends = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    poisson = np.searchsorted(ends, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)
    n_tried = -(-len(feats) // 3)

    packed = known.mapInArrow(_pack({g: i for i, g in enumerate(groups)}, thrs, tasks, len(keys), ROWS_PER_PIECE), "g int, slot int, n int, data binary")
    packed = packed.repartitionById(slots, F.col("slot")).persist(StorageLevel.DISK_ONLY)   # read once a level; in the heap it would leave little of it
    fits = [Forest(t, [], np.zeros((trees, 1)), np.ones((trees, 1), bool)) for t in thrs]
    try:
        for level in range(depth):
            tried = rng.random((trees, 2 ** level, len(feats))).argsort(-1)[:, :, :n_tried]
            sums = packed.mapInArrow(_histograms({i: f.levels for i, f in enumerate(fits)}, tried, salts, poisson, len(feats), BINS, TREES_PER_ROW), "g int, chunk int, data binary")
            best = sums.groupBy("g", "chunk").applyInArrow(_best_splits(tried, BINS, TREES_PER_ROW), "g int, chunk int, best binary").collect()   # a split per node
            _grow(fits, level, {(r["g"], r["chunk"]): r["best"] for r in best}, trees)
    finally:
        packed.unpersist()
    return dict(zip(groups, fits))


def _grow(fits: list[Forest], level: int, best: dict, trees: int) -> None:
    """Adds a level to the trees.  A node that does not split sends all rows left, to a node that no longer splits."""
    nodes = 2 ** level
    for g, f in enumerate(fits):
        feat, cut, wl, sl, wr, sr = np.concatenate([np.frombuffer(best[g, c]).reshape(6, -1, nodes) for c in range(0, trees, TREES_PER_ROW)], axis=1)
        if not level:   # a tree whose bag is empty tells 0, as Spark's does
            f.values = np.divide(sl + sr, wl + wr, out=np.zeros_like(sl), where=wl + wr > 0)
        splits = f.active & (cut < 255)
        with np.errstate(divide="ignore", invalid="ignore"):
            left, right = np.where(splits, sl / wl, f.values), np.where(splits, sr / wr, f.values)
        f.levels.append((feat.astype(np.uint8), np.where(splits, cut, 255).astype(np.uint8)))
        f.values = np.stack([left, right], -1).reshape(trees, -1)
        f.active = np.stack([splits, splits], -1).reshape(trees, -1)


def predict_forests(df: DataFrame, fits: dict[tuple, Forest], keys: Sequence[str], feats: Sequence[str], name: str = "pred") -> DataFrame:
    """Rows of the groups that have a forest, with the mean of its trees; the features are left out."""
    binned, words, tables, walk, numbers = _tasks()
    plain = {g: (f.thresholds, f.levels, f.values) for g, f in fits.items()}   # by value, not as a class of this module
    rest = [c for c in df.columns if c not in feats or c in keys]
    n_keys, n_rest = len(keys), len(rest)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        number = {g: i for i, g in enumerate(plain)}
        ready: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            g = numbers(batch.columns[:n_keys], number)
            x = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + n_rest:]])
            pred = np.full(batch.num_rows, np.nan)
            for key, k in number.items():
                at = np.flatnonzero(g == k)
                if not len(at):
                    continue
                thrs, levels, values = plain[key]
                if key not in ready:
                    ready[key] = tables(levels, len(thrs))
                bins = binned(thrs, x[at])
                word, flat, rows, n = words(bins), bins.ravel(), np.arange(len(at)), len(at)
                pred[at] = sum(values[t].take(walk(levels, t, flat, n, rows, word, ready[key])) for t in range(len(values))) / len(values)
            out = pa.RecordBatch.from_arrays([*batch.columns[n_keys:n_keys + n_rest], pa.array(pred)], names=[*rest, name])
            yield out.filter(pa.array(g >= 0))
    given = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
    return given.mapInArrow(run, T.StructType([*[df.schema[c] for c in rest], T.StructField(name, T.DoubleType())]))
