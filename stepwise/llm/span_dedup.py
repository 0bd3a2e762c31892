"""Suffix-array dedup: repeated byte strings found by a logarithmic index family.

What is indexed is a sparse set of suffixes.  Every string of ``length`` bytes
holds an anchor, the leftmost of its 32-byte grams with the smallest hash, so
equal strings hold equal anchors at equal offsets and it is enough to compare
suffixes around equal anchors.  An anchor stands for the short run of windows
(strings of ``length`` bytes) that choose it.

1.  Each task lists the anchors of its texts.  Copies of a whole run inside a
    slice are settled there, so that a passage in a third of all texts sends one
    entry per slice.  Entries are shuffled to buckets by gram.
2.  A bucket reads its entries in corpus order, batch by batch.  Each batch is
    sorted into a suffix array, merge-scanned against the levels of the family
    and added as a new level; levels of equal size merge, so n entries make
    O(log n) levels and each entry is merged O(log n) times.  An entry whose
    whole run was met before is removed; a gram met in different surroundings
    is left for step 3; all others occur once.
3.  The bytes around the open anchors are fetched, and the same family, now
    over whole windows in byte order, tells exactly which windows occurred
    before.  A gram left open in very many surroundings (the edge of a passage
    that a large part of the corpus shares) is split: its windows are sent one by
    one, settled per slice first, to buckets of their own digests.
4.  The removed windows are gathered per text and cut out.

Runs are compared by a 64-bit gram hash and a 64-bit hash of the surroundings,
windows in step 3 byte by byte, those of split grams by 128-bit digests.

Defined results: texts are bytes of UTF-8, a null text is empty; a text shorter
than ``length`` keeps everything; a string is removed where it starts later than
another occurrence, by (id, start), and rows that share an id and start are
ties that do not remove each other; a null id comes before all others; repeated
rows (same id and text) get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from stepwise.llm.chunks import span_index
from stepwise.llm.common import release, slices
from stepwise.session import write_and_reload

GRAM = 32
#: Bytes of text that a task handles at a time, and that one bucket of the index stands for.
SLICE, BUCKET_BYTES = 2 << 20, 16 << 20
#: Entries and windows of one batch of the family.
BATCH_ENTRIES, BATCH_WINDOWS = 1 << 17, 1 << 18
#: A gram open in more runs than this is split into single windows.
SPLIT_RUNS = 1000
_NULL_ID = -(1 << 63)
_BYTE = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64)
_ENTRIES = "bucket int, docs binary, keys binary, doc binary, start binary, width binary"


class IndexFamily:
    """Sorted levels of distinct keys, each a power of two of batches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []  # (generation, sorted keys), oldest first

    def add(self, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Index a batch that follows all earlier ones; True where a key occurred
        before: in a level, or in the batch at a smaller ``order`` (ascending)."""
        array = np.argsort(keys, kind="stable")  # the batch's suffix array
        ordered = keys[array]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        lead = np.flatnonzero(new)
        known = np.zeros(len(lead), bool)
        distinct = ordered[lead]
        for _, level in self.levels:  # merge scan
            at = np.searchsorted(level, distinct)
            at[at == len(level)] = 0
            known |= level[at] == distinct
        run = np.cumsum(new) - 1
        before = known[run] | (order[array] > order[array[lead]][run])
        fresh = distinct[~known]
        if len(fresh):
            generation = 0
            while self.levels and self.levels[-1][0] <= generation:
                older, level = self.levels.pop()
                fresh = np.sort(np.concatenate([level, fresh]), kind="stable")
                generation = max(generation, older) + 1
            self.levels.append((generation, fresh))
        seen = np.empty(len(keys), bool)
        seen[array] = before
        return seen

    def keys(self) -> np.ndarray:
        return np.sort(np.concatenate([k for _, k in self.levels]), kind="stable") if self.levels else np.empty(0, "S1")


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams and of all windows of ``length`` bytes, by doubling."""
    h, size, gram = _BYTE[data], 1, None
    while size * 2 <= length:
        h = _mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
        if size == GRAM:
            gram = h
    rest = length - size
    whole = _mix(h[:len(h) - rest] * np.uint64(0xBF58476D1CE4E5B9) + h[rest:]) if rest else h.copy()
    return gram, whole


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts laid end to end (``starts`` with the
    end appended): (gram hash, surroundings hash, first window, number of windows)."""
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < length:
        return none
    gram, whole = window_hashes(data, length)
    n, grams = len(data) - length + 1, length - GRAM + 1
    low, size = gram, 1
    while size * 2 <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[grams - size:grams - size + n])
    # the anchor changes with the smallest value, and after its own position
    cuts = np.flatnonzero((low[1:] != low[:-1]) | (gram[:n - 1] == low[:-1])) + 1
    long = np.diff(starts) >= length
    begin, last = starts[:-1][long], starts[1:][long] - length  # first and last window of each text
    if not len(begin):
        return none
    cuts = np.sort(np.concatenate([cuts, begin, last + 1]))
    cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
    first, end = cuts, np.r_[cuts[1:], n]
    text = np.searchsorted(begin, first, "right") - 1
    ok = (text >= 0) & (first <= last[np.maximum(text, 0)]) & (first < n)
    first, end = first[ok], end[ok]
    around = _mix(whole[first] * np.uint64(0x94D049BB133111EB) + whole[end - 1] + (end - first).astype(np.uint64))
    return low[first], around, first, end - first


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two 64-bit values as 16 bytes, ordered by the first and then the second."""
    return np.stack([a, b], 1).astype(">u8").view("S16").ravel()


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts in id order: (ids, text hashes, bytes, starts, offset of each
    piece in its text).  A long text comes in pieces that share length - 1 bytes; of
    rows equal in id and text a slice has one."""
    for b in slices(batches, "data", SLICE):
        k, h = b.column("k").to_numpy(), b.column("h").to_numpy()
        order = np.lexsort((h, k))
        new = np.r_[True, (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(order) else np.empty(0, bool)
        order = order[new]
        k, h = k[order], h[order]
        raw = [b.column("data")[int(i)].as_buffer() for i in order]
        if len(order) == 1 and raw[0] is not None and raw[0].size > 2 * SLICE:
            whole = np.frombuffer(raw[0], np.uint8)
            for at in range(0, len(whole) - length + 1, SLICE):
                part = whole[at:at + SLICE + length - 1]
                yield k, h, part, np.array([0, len(part)]), np.array([at])
            continue
        parts = [np.frombuffer(r, np.uint8) if r is not None else np.empty(0, np.uint8) for r in raw]
        starts = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        yield k, h, np.concatenate(parts), starts, np.zeros(len(k), np.int64)


def _dense(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ranks of (id, start) that are already in order; equal pairs share a rank."""
    return np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (start[1:] != start[:-1])])


def _rows(buckets: np.ndarray, docs: np.ndarray, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, width: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket with its entries packed; ``docs`` are (id, hash) pairs.

    Bucket -1 - b passes through the shuffle beside bucket b: entries already settled."""
    if not len(buckets):
        return None
    order = np.argsort(buckets, kind="stable")
    buckets, doc, start, width = buckets[order], doc[order], start[order], width[order]
    keys = keys[order] if len(keys) else keys
    lead = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    cols: list[list] = [[], [], [], [], [], []]
    for s, e in zip(lead, np.r_[lead[1:], len(buckets)]):
        own, where = np.unique(doc[s:e], return_inverse=True)
        for c, v in zip(cols, (int(buckets[s]), docs[own].tobytes(), keys[s:e].tobytes() if len(keys) else b"", where.astype(np.int32).tobytes(),
                               start[s:e].astype(np.int64).tobytes(), width[s:e].astype(np.int32).tobytes())):
            c.append(v)
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "docs", "keys", "doc", "start", "width"])


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids and hashes, start, width) of all entries of some rows, and their packed keys or bytes."""
    docs, start, width, keys = [], [], [], []
    for d, w, s, x, y in zip(*(table.column(c).to_pylist() for c in ("docs", "doc", "start", "width", "keys"))):
        docs.append(np.frombuffer(d, np.int64).reshape(-1, 2)[np.frombuffer(w, np.int32)])
        start.append(np.frombuffer(s, np.int64))
        width.append(np.frombuffer(x, np.int32))
        keys.append(y)
    if not docs:
        return np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate(docs), np.concatenate(start), np.concatenate(width).astype(np.int64), np.frombuffer(b"".join(keys), np.uint8)


def _found(docs: np.ndarray, start: np.ndarray, width: np.ndarray, open_in: np.ndarray) -> pa.Table:
    """Result entries; ``open_in`` is the bucket of step 3, or -1 for a removed run."""
    return pa.table({"k": docs[:, 0], "h": docs[:, 1], "start": start, "width": width.astype(np.int32), "open_in": open_in.astype(np.int32)})


_FOUND = "k long, h long, start long, width int, open_in int"


def _batch_ends(order: np.ndarray, weight: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut entries into batches of about ``limit`` weight that never part equal ranks."""
    total = np.cumsum(weight)
    s = 0
    while s < len(order):
        e = int(np.searchsorted(total, (total[s - 1] if s else 0) + limit, "right"))
        e = max(e, s + 1)
        while e < len(order) and order[e] == order[e - 1]:
            e += 1
        yield s, e
        s = e


def _settled(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Split a group's rows into entries to index and entries settled upstream."""
    done = pc.less(table.column("bucket"), 0)
    return table.filter(pc.invert(done)), table.filter(done)


def _spread(k: np.ndarray, h: np.ndarray, start: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that settled entries travel with: by id, text and 64 KB of the text, so
    that neither copies of a text nor a long one meet in one group."""
    mixed = _mix(h.astype(np.uint64) ^ _mix(k.astype(np.uint64)) ^ _mix((start >> 16).astype(np.uint64) + np.uint64(1)))
    return -1 - (_mix(mixed) % np.uint64(buckets)).astype(np.int64)


def find_repeats(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(k, h, start, width): removed runs of windows of ``docs`` (k, h, data)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    fine = 4 * buckets
    split_runs = SPLIT_RUNS

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, h, data, starts, offset in _pieces(batches, length):
            gram, around, first, width = anchors(data, starts, length)
            if not len(first):
                continue
            doc = np.searchsorted(starts, first, "right") - 1
            start = first - starts[doc] + offset[doc]
            keys = _pair_keys(gram, around)
            order = _dense(k[doc], start) if len(k) < 2 or (k[1:] > k[:-1]).all() else None
            if order is None:  # rows that share an id: rank by (id, start)
                by = np.lexsort((start, k[doc]))
                doc, start, width, keys, gram = doc[by], start[by], width[by], keys[by], gram[by]
                order = _dense(k[doc], start)
            seen = IndexFamily().add(keys, order)
            ids = np.stack([k, h], 1)
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            for part, b, key in ((~seen, bucket[~seen], keys[~seen]), (seen, _spread(k[doc[seen]], h[doc[seen]], start[seen], buckets), keys[:0])):
                rows = _rows(b, ids, key, doc[part], start[part], width[part])
                if rows is not None:
                    yield rows

    def index_entries(table: pa.Table) -> pa.Table:
        table, done = _settled(table)
        d0, s0, w0, _ = _unpack(done)
        ids, start, width, raw = _unpack(table)
        keys = raw.view("S16") if len(raw) else np.empty(0, "S16")
        by = np.lexsort((start, ids[:, 0]))
        ids, start, width, keys = ids[by], start[by], width[by], keys[by]
        seen = np.zeros(len(keys), bool)
        family = IndexFamily()
        if len(keys):
            order = _dense(ids[:, 0], start)
            for s, e in _batch_ends(order, np.ones(len(keys), np.int64), BATCH_ENTRIES):
                seen[s:e] = family.add(keys[s:e], order[s:e])
        # grams met in several surroundings stay open
        gram = keys.view(">u8")[::2].astype(np.uint64)
        found, count = np.unique(family.keys().view(">u8")[::2].astype(np.uint64) if len(keys) else gram, return_counts=True)
        several = count[np.searchsorted(found, gram)] > 1 if len(gram) else np.zeros(0, bool)
        open_ = ~seen & several
        open_in = np.where(open_, (gram % np.uint64(fine)).astype(np.int64), -1)
        which, runs = np.unique(gram[open_], return_counts=True)
        open_in[open_ & np.isin(gram, which[runs > split_runs])] = fine
        out = seen | open_
        release()
        return pa.concat_tables([_found(ids[out], start[out], width[out], open_in[out]), _found(d0, s0, w0, np.full(len(s0), -1))])

    entries = docs.mapInArrow(list_anchors, _ENTRIES)
    own = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    found = write_and_reload(entries.groupBy(own.alias("own")).applyInArrow(index_entries, _FOUND), "repeats")

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] + [pa.binary()] * 5
        for b in slices(batches, "data", SLICE):
            cols: list[list] = [[], [], [], [], [], []]
            split: list[tuple[int, int, int, bytes]] = []
            for k, h, raw, runs in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), b.column("data"), b.column("runs").to_pylist()):
                data = raw.as_buffer()
                by_bucket: dict[int, list[tuple[int, int]]] = {}
                for r in runs:
                    by_bucket.setdefault(r["open_in"], []).append((r["start"], r["width"]))
                for bucket, some in by_bucket.items():
                    if bucket == fine:
                        split += [(k, i, h, xxh3_128_digest(data[i:i + length])) for s, w in some for i in range(s, s + w)]
                        continue
                    start, width = np.array([s for s, _ in some]), np.array([w for _, w in some])
                    around = b"".join([data[s:s + w + length - 1].to_pybytes() for s, w in some])
                    for c, v in zip(cols, (bucket, np.array([k, h], np.int64).tobytes(), around, np.zeros(len(some), np.int32).tobytes(),
                                           start.tobytes(), width.astype(np.int32).tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "docs", "keys", "doc", "start", "width"])
            if split:
                split.sort(key=lambda x: x[:2])
                k, start, h = (np.array([x[i] for x in split], np.int64) for i in range(3))
                keys = np.frombuffer(b"".join([x[3] for x in split]), "S16")
                seen = IndexFamily().add(keys, _dense(k, start))
                home = (keys.view("<u8")[::2] % np.uint64(fine)).astype(np.int64)
                ids, one = np.stack([k, h], 1), np.ones(len(k), np.int64)
                for part, bucket, key in ((~seen, fine + home[~seen], keys[~seen]), (seen, -1 - fine - np.abs(h[seen] % fine), keys[:0])):
                    rows = _rows(bucket, ids, key, np.flatnonzero(part), start[part], one[part])
                    if rows is not None:
                        yield rows

    def index_windows(table: pa.Table) -> pa.Table:
        table, done = _settled(table)
        d0, s0, w0, _ = _unpack(done)
        out: list[pa.Table] = [_found(d0, s0, w0, np.full(len(s0), -1))]
        ids, start, width, data = _unpack(table)
        singles = table.num_rows and table.column("bucket")[0].as_py() >= fine  # a bucket of split grams
        size = np.full(len(width), 16) if singles else width + length - 1
        at = np.cumsum(size) - size
        by = np.lexsort((start, ids[:, 0]))
        ids, start, width, at = ids[by], start[by], width[by], at[by]
        rank = _dense(ids[:, 0], start) if len(by) else start
        family = IndexFamily()
        # runs of one text are apart, so (run, window) is the corpus order
        for s, e in _batch_ends(rank, width, BATCH_WINDOWS):
            window = span_index(at[s:e], width[s:e])
            long = 16 if singles else length
            keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, long)[window]).view(f"S{long}").ravel()
            run = np.repeat(np.arange(s, e), width[s:e])
            begin = start[run] + window - at[run]
            seen = family.add(keys, rank[run] * length + (begin - start[run]))
            hit = np.flatnonzero(seen)
            if len(hit):  # runs of neighbouring windows
                lead = np.r_[True, (run[hit[1:]] != run[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)]
                first = hit[lead]
                size = np.diff(np.r_[np.flatnonzero(lead), len(hit)])
                out.append(_found(ids[run[first]], begin[first], size, np.full(len(first), -1)))
        release()
        return pa.concat_tables(out)

    # a set: rows equal in id and text have the same runs, so it is bounded by the text
    opened = found.where("open_in >= 0").groupBy("k", "h").agg(F.collect_set(F.struct("start", "width", "open_in")).alias("runs"))
    late = docs.join(opened, ["k", "h"]).select("k", "h", "data", "runs").dropDuplicates(["k", "h"])
    late = late.mapInArrow(list_windows, _ENTRIES).groupBy(own.alias("own")).applyInArrow(index_windows, _FOUND)
    return found.where("open_in < 0").select("k", "h", "start", "width").union(late.select("k", "h", "start", "width"))


def _cut(data: bytes, runs: list, length: int, whole_chars: bool) -> tuple[list[dict], bytes]:
    """Maximal removed spans of one text and the bytes that stay."""
    spans: list[list[int]] = []
    for s, w in sorted((r["start"], r["width"]) for r in runs):
        e = s + w + length - 1
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    if whole_chars:  # leave characters that are removed in part
        for x in spans:
            while x[0] < x[1] and data[x[0]] & 0xC0 == 0x80:
                x[0] += 1
            while x[0] < x[1] < len(data) and data[x[1]] & 0xC0 == 0x80:
                x[1] -= 1
        spans = [x for x in spans if x[0] < x[1]]
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    kept.append(data[at:])
    return [{"start": s, "end": e} for s, e in spans], b"".join(kept)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, whole_chars: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) per row, and the ``keep`` columns of ``df``.

    ``kept`` are the bytes that no repeated string covers; ``whole_chars`` shrinks
    spans to whole characters, so that ``kept`` is UTF-8 again."""
    spark = df.sparkSession
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    src = df.select(F.col(id_col).alias("id"), data.alias("data"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    src = src.withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(_NULL_ID))).withColumn("h", F.xxhash64("data"))
    total = src.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    runs = find_repeats(src.select("k", "h", "data"), length, buckets).groupBy("k", "h").agg(F.collect_set(F.struct("start", "width")).alias("runs"))
    joined = src.join(runs, ["k", "h"], "left").drop("k", "h")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("data", "runs"))
    others = [c for c in joined.columns if c not in ("data", "runs")]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data", SLICE):
            spans, kept, size = [], [], []
            for raw, found in zip(b.column("data").to_pylist(), b.column("runs").to_pylist()):
                got, rest = _cut(raw, found, length, whole_chars) if found else ([], raw)
                spans.append(got)
                kept.append(rest)
                size.append(len(raw))
            n = pa.array(size, pa.int64())
            left = pa.array([len(x) for x in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], n, pc.subtract(n, left), pa.array(spans, span_type), pa.array(kept, pa.binary())],
                                             [*others, "n_bytes", "n_removed", "spans", "kept"])

    out = joined.mapInArrow(finish, fields + ", n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.select("id", "n_bytes", "n_removed", "spans", "kept", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
