"""Best-fit packing by a configuration linear program.

Documents become token ids with an end id; longer ones are cut into full pieces,
the first of which may be shorter.  Only the histogram of piece lengths is
optimised: its configuration program (cover every length by fillings of one
sequence, with as few sequences as possible) is solved by multiplicative
weights, a knapsack program over the capacity pricing the next filling.  The
fractional answer is rounded down, and what is left is packed by the same
pricing on the remaining counts, best fit at the end.  The histogram has at most
``capacity`` entries, so driver work does not grow with the corpus.

Pieces then take their places in parallel: a piece's rank among those of its
length comes from counts per partition, and a broadcast table of runs maps ranks
to sequences and offsets.  A run stands for all copies of one size in one filling,
so a filling has at most sqrt(2 x capacity) of them.  The table does not grow with
the corpus: the program sees shares of the demand, and a round adds at most
4 x capacity fillings.  It is held under ``MAX_PLAN_BYTES`` all the same: a plan
beyond is solved again with half the rounds.

Defined results: a null or empty text is one piece, the end id; repeated rows are
packed as often as they occur; strings of special tokens in a text are ordinary
text; an empty table gives no rows.  A very long text is tokenised whole, alone in
its batch, and becomes many pieces; columns of other names do not matter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.chunks import DistinctChunks, join_texts, span_index, white_space
from stepwise.llm.common import share, slices, worker_cache
from stepwise.session import write_and_reload

#: Texts tokenised together, in bytes.
BATCH_BYTES = 3 << 20
#: The most a broadcast plan may take.
MAX_PLAN_BYTES = 32 << 20


# ---- tokens ----
# The splitting pattern of the vocabulary always cuts in front of a blank between
# two characters that are not white space, so texts are tokenised chunk by chunk.

def byte_level_ranks(tokenizer_json: str) -> tuple[dict[bytes, int], str]:
    """Ranks of a byte-level BPE tokenizer file, and the pattern that splits text before its merges."""
    from public_tokenizers import PATTERN
    spec = json.loads(tokenizer_json)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a prefix blank is covered")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, PATTERN


class ChunkTokenizer:
    """Token ids of a batch of texts, each distinct chunk encoded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken
        self.plain = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin, the end appended)."""
        data, starts = join_texts(texts)
        blank = white_space(data)
        at = np.flatnonzero(data[1:-1] == 32) + 1
        at = at[~blank[at - 1] & ~blank[at + 1]]  # a text's first or last blank may count: see below
        inside = np.zeros(len(data) + 1, bool)
        inside[starts] = True
        at = at[~inside[at + 1]]  # not a text's last byte
        c = DistinctChunks(data, starts, at)
        begin, size = c.starts[c.first], c.sizes[c.first]
        # chunks that open with their blank and end in no white space can be encoded in a row
        alone = np.ones(len(begin), bool)
        if len(begin):
            alone = (data[begin] != 32) | blank[begin + size - 1] | blank[np.minimum(begin + 1, len(data) - 1)]
        row = np.flatnonzero(~alone)
        ids = np.array(self.plain(data[span_index(begin[row], size[row])].tobytes().decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[row]))  # index of each chunk's last token
        counts = np.zeros(len(begin), np.int64)
        counts[row] = np.diff(np.r_[-1, ends])
        single = [np.array(self.plain(data[begin[i]:begin[i] + size[i]].tobytes().decode()), np.uint32) for i in np.flatnonzero(alone)]
        counts[alone] = [len(x) for x in single]
        pool = np.concatenate([ids, *single]) if len(begin) else ids
        # the pool holds the chunks encoded in a row, then the others
        place = np.empty(len(begin), np.int64)
        order = np.r_[row, np.flatnonzero(alone)]
        place[order] = np.cumsum(counts[order]) - counts[order]
        sizes = counts[c.inverse]
        return pool[span_index(place[c.inverse], sizes)], np.r_[0, np.cumsum(sizes)][c.text_chunks]


def token_pieces(df: DataFrame, tokenizer_json: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, k): the pieces of every document;
    ``k`` numbers the pieces of one length inside a partition ``part``."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    vocabulary = share(df.sparkSession, byte_level_ranks(tokenizer_json))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"chunk-tokenizer-{zlib.crc32(tokenizer_json.encode())}"
        tokens = worker_cache(key, lambda: ChunkTokenizer(*vocabulary()))
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last = np.array([end_id], np.uint32)
        for b in slices(batches, "text", BATCH_BYTES):
            at, piece, start, length, crc = [], [], [], [], []
            flat, begins = tokens.batch([t or "" for t in b.column("text").to_pylist()])
            flat = flat.astype("<u4")
            for i, (x, y) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                view = memoryview(np.r_[flat[x:y], last].astype("<u4").tobytes())
                n = y - x + 1
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for j, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    piece.append(j)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(view[4 * s:4 * e]))
            size = np.array(length)
            k = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            lens, first, counts = np.unique(size[order], return_index=True, return_counts=True)
            for v, f, c in zip(lens, first, counts):
                k[order[f:f + c]] = seen[v] + np.arange(c)
                seen[v] += c
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int64()), pa.array(k)], ["id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return src.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, part long, k long")


# ---- the program over the histogram ----

def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value for every room up to ``capacity`` (unbounded), and the size picked there (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if m := fits[c]:
            got = best[c - sizes[:m]] + values[:m]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], pick[c] = got[i], i
    return best, pick


def _trace(pick: np.ndarray, sizes: list[int], room: int) -> list[int]:
    out = []
    while room > 0:
        i = int(pick[room])
        if i < 0:
            room -= 1
        else:
            out.append(i)
            room -= sizes[i]
    return out


def fractional(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int) -> dict[tuple[int, ...], float]:
    """Fillings (as indices of sizes) and how often each is used, to cover ``counts``.

    Multiplicative weights: round r aims at covering the share r/rounds of every
    demand.  A size's price is its length, which is optimal when all sequences can
    be full, times a factor that falls with its coverage and is 0 beyond the aim.
    The knapsack table of a pricing holds the best filling around every size;
    lagging sizes, longest first, use theirs while it is close to the best."""
    eta, slack = 0.5, 0.5 / rounds
    covered = np.zeros(len(sizes))
    used: dict[tuple[int, ...], float] = {}
    listed = sizes.tolist()
    for r in range(1, rounds + 1):
        aim = r / rounds
        for tolerance in (0.002, 0.005, 0.01, 0.02):
            lagging = np.flatnonzero(covered < aim - 1e-9)
            if not len(lagging):
                break
            price = np.where(covered < aim, sizes * np.exp(-eta * (covered - aim)), 0.0)
            best, pick = knapsack(price, sizes, capacity)
            around = price + best[capacity - sizes]
            for i in lagging[::-1]:
                if covered[i] >= aim or around[i] < best[capacity] * (1 - tolerance):
                    continue
                filling = (int(i), *_trace(pick, listed, capacity - listed[i]))
                each, k = np.unique(filling, return_counts=True)
                times = float((np.maximum(aim + slack - covered[each], 0) * counts[each] / k).min())
                if times > 0:
                    covered[each] += times * k / counts[each]
                    key = tuple(sorted(filling, reverse=True))
                    used[key] = used.get(key, 0.0) + times
    return used


def rounded(used: dict[tuple[int, ...], float], counts: np.ndarray, sizes: np.ndarray, capacity: int, scale: float) -> list[tuple[list[int], int]]:
    """Whole fillings that cover ``counts`` exactly: the scaled fractional answer
    rounded down, and the rest packed best fit."""
    left = counts.copy()
    out: list[tuple[list[int], int]] = []

    def use(filling: tuple[int, ...], most: float) -> None:
        each, k = np.unique(filling, return_counts=True)
        times = min(int(most), int((left[each] // k).min()))
        if times:
            left[each] -= times * k
            out.append(([int(sizes[i]) for i in sorted(filling, reverse=True)], times))

    # fuller fillings first, never more than is left
    for filling, times in sorted(used.items(), key=lambda x: -sum(sizes[i] for i in x[0])):
        use(filling, times / scale)
    # the longest piece left, then the longest that still fits, again and again
    while left.any():
        room, filling, i = capacity, [], len(sizes) - 1
        while i >= 0 and room >= sizes[0]:
            i = min(i, int(np.searchsorted(sizes, room, "right")) - 1)
            while i >= 0 and not left[i]:
                i -= 1
            if i < 0:
                break
            n = min(int(left[i]), room // int(sizes[i]))
            filling += [i] * n
            room -= n * int(sizes[i])
            i -= 1
        use(tuple(filling), 1 << 62)
    return out


def plan(histogram: dict[int, int], capacity: int, rounds: int = 60) -> list[tuple[list[int], int]]:
    """(sizes of one filling, largest first; how many sequences use it), covering the
    histogram exactly; of several roundings the one with fewest sequences."""
    whole = [([s], n) for s, n in sorted(histogram.items()) if s == capacity and n]
    items = sorted((s, n) for s, n in histogram.items() if 0 < s < capacity and n)
    if not items:
        return whole
    sizes, counts = np.array([s for s, _ in items]), np.array([n for _, n in items])
    used = fractional(counts.astype(float), sizes, capacity, rounds)
    tries = [rounded(used, counts, sizes, capacity, scale) for scale in (1.0, 1.01, 1.03, 1.2, 2.0, 4.0)]
    return whole + min(tries, key=lambda t: sum(n for _, n in t))


def runs(fillings: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per size: columns (first rank, first sequence, offset, copies in a sequence) of its runs of ranks."""
    times_of: dict[tuple[int, ...], int] = {}
    for sizes, times in fillings:
        times_of[tuple(sizes)] = times_of.get(tuple(sizes), 0) + times
    taken: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for sizes, times in times_of.items():
        offset = 0
        for s in sorted(set(sizes), reverse=True):
            k = sizes.count(s)
            table.setdefault(s, []).append((taken.get(s, 0), sequence, offset, k))
            taken[s] = taken.get(s, 0) + times * k
            offset += s * k
        sequence += times
    return {s: np.array(t, np.int64).T for s, t in table.items()}


def plan_table(histogram: dict[int, int], capacity: int, rounds: int, most: int = MAX_PLAN_BYTES) -> dict[int, np.ndarray]:
    """The runs of a plan of at most ``most`` bytes; fewer rounds give fewer fillings."""
    while True:
        table = runs(plan(histogram, capacity, rounds))
        size = sum(t.nbytes for t in table.values())
        if size <= most:
            return table
        if rounds <= 1:
            raise ValueError(f"a plan of {size} bytes for {len(histogram)} lengths; the limit is {most}")
        rounds //= 2


def pack(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, rounds: int = 60) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    spark = df.sparkSession
    pieces = write_and_reload(token_pieces(df, tokenizer_json, id_col, text_col, capacity, end_id), "pieces")
    per_part = write_and_reload(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = share(spark, plan_table(histogram, capacity, rounds))
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                first, start, offset, copies = table()[int(s)]
                j = np.searchsorted(first, rank[own], "right") - 1
                later, copy = np.divmod(rank[own] - first[j], copies[j])
                seq[own], off[own] = start[j] + later, offset[j] + copy * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:5])
    return ranked.mapInArrow(place, fields + ", sequence_id long, offset long")
