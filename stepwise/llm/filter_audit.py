"""Filter interaction audit over all orders of five filters.

Which filters a document fails is a mask of five bits, and all that an order
of the filters does to a document depends on its mask.  Orders are numbered by
their Lehmer code, that is in lexicographic order, so all orders that begin
with the same letters form one interval of ranks.  A mask is removed at step s
by filter f in the orders that begin with s - 1 filters it passes, then f: one
interval for each such beginning.  The documents of a mask are added where its
intervals begin, taken off where they end, and prefix sums over the ranks give
what each step of each order removes.  The corpus is counted once by
(part, mask), whatever the number of orders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.common import BLANKS, slices
from stepwise.session import write_and_reload

LETTERS = "ABCDE"
N = len(LETTERS)
ORDERS = factorial(N)
MASKS = 1 << N
SYMBOL = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(65, 91))
#: Texts handed to Python, and parts of one text cut into words, at a time, in bytes.
SLICE = 4 << 20


def word_counts(raw: bytes) -> tuple[int, int]:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` and of distinct ones, read window by window."""
    blank = re.compile(b"[" + BLANKS.encode() + b"]")
    n, seen, at = 0, set(), 0
    while at < len(raw):
        m = blank.search(raw, at + SLICE)
        end = m.start() if m else len(raw)
        words = raw[at:end].split()  # bytes split at exactly these six blanks
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails (A is bit 0)."""
    n, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, UPPER))
    chars = len(raw) if raw.isascii() else len(raw.decode())
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * upper > 5 * chars) << 2 | (SYMBOL.search(raw) is not None) << 3


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Rows (id, part, mask, digest), the mask with bits A to D and a 128-bit digest of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", SLICE):
            masks, digests = [], []
            for raw in b.column("_text"):
                raw = raw.as_py() or b""
                masks.append(text_failures(raw))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                             ["id", "part", "mask", "digest"])

    return src.mapInArrow(run, f"id {kind}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the set of filters they fail."""
    rows = write_and_reload(failures(docs, id_col, text_col, part_col), "filter-marks")
    tags = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    # texts there are twice, with the smallest id; written, as are the labels, so that the joins below
    # have plain exchanges on both sides, of which large partitions can be split
    again = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    rows = (rows.join(write_and_reload(again, "filter-again"), "digest", "left")
            .join(write_and_reload(tags.where("id IS NOT NULL AND good + toxic > 0"), "filter-labels"), "id", "left"))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return (rows.groupBy("part", (F.col("mask") + later * (1 << (N - 1))).alias("mask"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")))


def lehmer_rank(prefix: tuple[int, ...]) -> int:
    """Rank of the first order that begins with ``prefix``, in lexicographic order."""
    rest, rank = list(range(N)), 0
    for i, f in enumerate(prefix):
        rank += rest.index(f) * factorial(N - 1 - i)
        rest.remove(f)
    return rank


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """Rows (mask, step, lo, hi): a mask goes at this step in the orders ranked lo to hi - 1."""
    out = []
    for mask in range(1, MASKS):
        fails = [f for f in range(N) if mask >> f & 1]
        passes = [f for f in range(N) if not mask >> f & 1]
        for k in range(len(passes) + 1):
            for before in permutations(passes, k):
                for f in fails:
                    lo = lehmer_rank((*before, f))
                    out.append((mask, k + 1, lo, lo + factorial(N - 1 - k)))
    return out


def audit(counts: DataFrame) -> DataFrame:
    """Audit rows of all orders and steps from counts (part, mask, n, good, toxic).

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley), 5 steps of 120 orders for each part, zeros included."""
    spark = counts.sparkSession
    counts = counts.repartition("part")  # at most 32 rows a part; all that follows stays within a part
    lasts = F.broadcast(spark.createDataFrame(removal_intervals(), "mask int, step int, lo int, hi int"))  # 840 rows
    names = F.array(*[F.lit("".join(o)) for o in permutations(LETTERS)])

    ends = counts.join(lasts, "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("lo").alias("rank"), *["n", "good", "toxic"]),
        F.struct(F.col("hi").alias("rank"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]))).alias("e")).select("part", "step", "e.*")
    by_letter = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(N)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(N)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*by_letter).alias("failing"), F.array(*alone).alias("alone"))
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(N))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    steps = ends.where(F.col("rank") < ORDERS).unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "step", "rank", F.sum("n").over(along).alias("removed"), F.sum("good").over(along).alias("good_lost"),
                         F.sum("toxic").over(along).alias("toxic_lost"))
    steps = steps.join(totals, "part").withColumn("filter_order", F.element_at(names, F.col("rank") + 1))
    steps = steps.withColumn("_f", F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))))
    through = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    failing, single = F.element_at("failing", F.col("_f")), F.element_at("alone", F.col("_f"))
    return steps.select("part", "filter_order", "step", (F.col("total") - F.sum("removed").over(through)).alias("kept"), "removed",
                        (failing - F.col("removed")).alias("redundant"), single.alias("unique_fails"), "good_lost", "toxic_lost",
                        F.sum("removed").over(Window.partitionBy("part", "_f")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What the filters A to E remove from each part in each of their 120 orders.

    A: under 50 words.  B: distinct words under 65 % of the words.  C: A-Z over 5 % of
    the code points.  D: any of ``#$%&*|``.  E: the text equals that of a smaller id
    anywhere in the table.  Labels mark good (quality 1) and toxic (1) documents.

    * null text: empty (fails A only, and E after the first such id);
    * null part: the empty string, together with a part of that name;
    * null id: neither smaller nor larger than another, so such a row never fails E and makes no other fail, and it has no label;
    * rows with one id and equal texts: each counts, none is a later copy of the other;
    * several label rows of one id: a mark in any of them holds; null labels mark nothing;
    * very long texts: words are counted window by window, a task holds the distinct words of one text;
    * an empty table gives no rows; other columns of either table are not read.
    """
    return audit(mask_counts(docs, labels, id_col, text_col, part_col))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT w.doc_id, part,
        (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (w.doc_id > first_id)::INT AS mask,
        coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic
      FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT 'ABCDE'[i + 1] AS letter, 1 << i AS bit FROM range(5) r(i)),
p(filter_order) AS (SELECT letter FROM f UNION ALL SELECT filter_order || letter FROM p, f WHERE NOT contains(filter_order, letter)),
s AS (SELECT p.filter_order, k.step::INT AS step, f.letter, f.bit,
        (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE contains(p.filter_order[1:k.step - 1], g.letter))::INT AS before
      FROM p, range(1, 6) k(step), f WHERE length(p.filter_order) = 5 AND f.letter = p.filter_order[k.step]),
r AS (SELECT c.part, s.filter_order, s.step, s.letter,
        sum(c.n) FILTER (WHERE c.mask & (s.before | s.bit) = 0) AS kept,
        sum(c.n) FILTER (WHERE c.mask & s.before = 0 AND c.mask & s.bit > 0) AS removed,
        sum(c.n) FILTER (WHERE c.mask & s.before > 0 AND c.mask & s.bit > 0) AS redundant,
        sum(c.n) FILTER (WHERE c.mask = s.bit) AS unique_fails,
        sum(c.good) FILTER (WHERE c.mask & s.before = 0 AND c.mask & s.bit > 0) AS good_lost,
        sum(c.toxic) FILTER (WHERE c.mask & s.before = 0 AND c.mask & s.bit > 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM r
"""
