"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most three bits share at least five of them, so the index posts every
distinct fingerprint under its byte positions, five at a time: 56 lists, each
keyed by the chosen positions and their bytes.  A pair that meets in a list has
the guaranteed five by that, and is verified by bit count; in lists over ``DIRECT``
members every value up to three bits away is looked up instead.  Counting shared
bytes pair by pair, over lists of one or two positions, would give the same links
from pairs that grow with the square of the corpus (README has the figures);
five-byte lists hold only fingerprints equal in 40 bits, at most 2**24.

Copies fall together before the index (one row per fingerprint), a list emits
at most one link per member (to the smallest member reachable inside the list),
never its pairs, and components are found by Spark rounds.

Defined results: a null text has no words; no words give fingerprint zero;
fewer words than the shingle give one shingle of the whole sequence; repeated
rows and ties share a fingerprint and a component; a null id takes part but is
never the smallest id; an empty table gives no rows.  A very long text is hashed
whole, its bits counted a bounded number of shingles at a time; columns of other
names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import release, slices
from stepwise.llm.components import connected_components
from stepwise.session import write_and_reload

#: Lists up to this many fingerprints compare members directly, longer ones probe neighbours.
DIRECT = 1024


def fingerprint_text(text: str | None, n: int, seed: int) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles of a text."""
    import xxhash
    found = (text or "").encode().lower().split()  # bytes.split cuts at \x20 and \x09-\x0D
    if not found:
        return 0
    flat = b" ".join(found)
    n = min(n, len(found))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - n + 1].tolist()
    h = xxhash.xxh64_intdigest
    votes = np.array([h(flat[s:e], seed) for s, e in zip(starts, ends[n - 1:].tolist())], ">u8")
    bits = np.zeros(64, np.int64)
    for i in range(0, len(votes), 1 << 16):  # a bounded bit matrix
        bits += np.unpackbits(votes[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(votes)).tobytes(), "big")


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42, marks: tuple[Column, ...] = ()) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; then the longs ``marks`` as m0, m1 and so on."""
    names = [f"m{i}" for i in range(len(marks))]
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[m.cast("long").alias(c) for m, c in zip(marks, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint_text(t.as_py(), n, seed) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp), *[b.column(c) for c in names]], ["id", "fp", *names])

    return src.mapInArrow(run, "id long, fp long" + "".join(f", {c} long" for c in names))


def _lowest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook links a-b into ``root`` (index of the smallest member) until nothing changes."""
    while True:
        lo = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], lo)
        np.minimum.at(root, root[b], lo)
        np.minimum.at(root, a, lo)
        np.minimum.at(root, b, lo)
        root[:] = root[root]
        if np.array_equal(before, root):
            return


def _links_direct(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (as positions) inside short lists, lag by lag."""
    stop = np.repeat(ends, ends - starts)
    size = ends - starts
    pos = np.arange(len(stop)) + np.repeat(starts - (np.cumsum(size) - size), size)
    out_a, out_b = [], []
    lag = 1
    while len(pos):
        keep = pos + lag < stop
        pos, stop = pos[keep], stop[keep]
        if not len(pos):
            break
        x = fp[pos] ^ fp[pos + lag]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        ok = (tally >= shared) & (np.bitwise_count(x) <= bits)
        out_a.append(pos[ok])
        out_b.append(pos[ok] + lag)
        lag += 1
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _star_probe(fp: np.ndarray, free: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long list, whose members differ only in the ``free`` byte
    positions: look every neighbour value up in a dense table of 2**24 slots."""
    word = fp.view(np.uint8).reshape(-1, 8)[:, ::-1]  # big-endian byte positions
    value = np.zeros(len(fp), np.int64)
    for p in free:
        value = (value << 8) | word[:, p]
    slot = np.full(1 << 8 * len(free), -1, np.int32)
    slot[value] = np.arange(len(fp), dtype=np.int32)
    width = 8 * len(free)
    root = np.arange(len(fp))
    for k in range(1, bits + 1):
        for picks in combinations(range(width), k):
            other = slot[value ^ sum(1 << p for p in picks)]
            here = np.flatnonzero(other > np.arange(len(fp)))
            if len(here):
                here = here[root[here] != root[other[here]]]
                _lowest(root, here, other[here].astype(np.int64)) if len(here) else None
    leaf = np.flatnonzero(root != np.arange(len(fp)))
    return root[leaf], leaf


def _links(keys: np.ndarray, fp: np.ndarray, subsets: list[tuple[int, ...]], bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (pairs of fingerprints) of the whole lists in sorted ``keys``."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    some = ends - starts > 1
    starts, ends = starts[some], ends[some]
    short = ends - starts <= DIRECT
    a, b = _links_direct(fp, starts[short], ends[short], bits, shared)
    if len(a):
        root = np.arange(len(fp))
        _lowest(root, a, b)
        b = np.unique(np.r_[a, b])
        b = b[root[b] != b]
        a = root[b]
    out = [(fp[a], fp[b])]
    for s, e in zip(starts[~short], ends[~short]):
        chosen = subsets[int(keys[s]) >> 40]
        i, j = _star_probe(fp[s:e], [p for p in range(8) if p not in chosen], bits)
        out.append((fp[s:e][i], fp[s:e][j]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def link_fingerprints(fps: DataFrame, fp_col: str = "fp", bits: int = 3) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints.  Each joins a member of a
    list to the smallest one that verified pairs of that list (``bits`` or fewer
    differing bits) lead to; together they connect exactly what the pairs connect."""
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1 to 3: the index keeps the 8 - bits positions that must agree, three free bytes at most")
    shared = 8 - bits
    subsets = list(combinations(range(8), shared))
    distinct = fps.select(F.col(fp_col).cast("long").alias("fp")).where("fp is not null").distinct()
    # eight bytes a row become 16 a posting, many times over: small partitions must not be drawn together before that
    distinct = distinct.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def byte(p: int):
        return F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))

    def key(i: int, chosen: tuple[int, ...]):
        if bits < 3:  # more than five bytes: hash them; a clash only adds candidates
            return F.xxhash64(F.lit(i), *[byte(p) for p in chosen])
        packed = F.lit(i).cast("long")
        for p in chosen:
            packed = F.shiftleft(packed, 8).bitwiseOR(byte(p))
        return packed

    posts = distinct.select(F.explode(F.array(*[key(i, c) for i, c in enumerate(subsets)])).alias("k"), "fp")
    # a list comes as one run of a sorted partition, cut at batch ends below
    posts = posts.repartition("k").sortWithinPartitions("k", "fp")
    direct_only = bits < 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the list that may go on

        def emit(k, f):
            if direct_only:
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                a, b = _links_direct(f, starts, np.r_[starts[1:], len(k)], bits, shared)
                x, y = f[a], f[b]
            else:
                x, y = _links(k, f, subsets, bits, shared)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        def joined():
            return np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])

        for batch in batches:
            k, f = batch.column("k").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(k):
                continue
            if not held or held[0][0][0] != k[-1]:
                held.append((k, f))
                k, f = joined()
                cut = int(np.searchsorted(k, k[-1], "left"))
                if cut:
                    yield emit(k[:cut], f[:cut])
                k, f, held = k[cut:], f[cut:], []
            held.append((k, f))
        if held:
            yield emit(*joined())
        held.clear()
        release()

    return posts.mapInArrow(run, "a long, b long").distinct()


def _with_roots(first: DataFrame, bits: int) -> DataFrame:
    """``first``, one row per fingerprint, with ``root``: the smallest linked fingerprint."""
    roots = connected_components(link_fingerprints(first, "fp", bits), "a", "b")
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return linked.select(*first.columns, F.coalesce("root", "fp").alias("root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) per row; ``component_id`` is the smallest id whose
    fingerprint is reachable through links (null where every such id is null)."""
    fps = write_and_reload(simhash(df, id_col, text_col, n, seed), "simhash")
    first = write_and_reload(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-first")
    linked = write_and_reload(_with_roots(first, bits), "simhash-roots")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = linked.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_first_of_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, bits: int = 3) -> DataFrame:
    """One row of ``df``, all columns, for each component: the one with the smallest id.

    A null id comes after all others.  Of rows that share the id, the one whose text,
    and then whose other columns, come first by hash and length; equal rows collapse."""
    text = F.col(text_col).cast("string")
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    marks = (F.xxhash64(text), F.coalesce(F.octet_length(text), F.lit(-1)), F.xxhash64(*hashable))
    names = ["m0", "m1", "m2"]
    fps = simhash(df, id_col, text_col, n, marks=marks)
    place = F.struct(F.col("id").isNull().alias("none"), "id", *names)
    first = write_and_reload(fps.groupBy("fp").agg(F.min(place).alias("place")), "simhash-first")
    stay = write_and_reload(_with_roots(first, bits).groupBy("root").agg(F.min("place").alias("place")).select("place.id", *[f"place.{c}" for c in names]), "simhash-stay")
    stay = stay.toDF("_keep_id", *[f"_keep_{c}" for c in names])
    own = df.withColumns({"_own_id": F.col(id_col).cast("long"), **{f"_own_{c}": m.cast("long") for c, m in zip(names, marks)}})
    same = F.col("_own_id").eqNullSafe(F.col("_keep_id"))
    for c in names:
        same = same & (F.col(f"_own_{c}") == F.col(f"_keep_{c}"))
    kept = own.join(stay, same, "left_semi").dropDuplicates(["_own_id", *[f"_own_{c}" for c in names]])
    return kept.drop("_own_id", *[f"_own_{c}" for c in names])
