"""Line dedup over levelled sorted runs of line hashes.

A *run* is a table of line hashes, sorted, each with the number of documents
that hold the line and the largest id among them.  A batch of documents is
merge-joined with the runs there are: lines that no run knows become the
batch's own run, for the others only the number of documents is kept.  Runs
are therefore disjoint.  When ``fanout`` runs stand on one level they are
merged into one on the next, so a batch meets few runs.

Batches are added from the largest ids down, hence the id that a run holds is
the largest one of all documents.  The hash has 128 bits (BLAKE2b).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import BLANKS, release, slices
from stepwise.session import scratch_path, write_and_reload

STRIP = BLANKS.encode()
#: Texts handed to Python at a time inside a task, in bytes.
SLICE = 4 << 20
#: Rows of an emitted Arrow batch.
ROWS = 50_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key (blanks at both ends gone, A-Z lower-cased); None for keys under ``min_chars`` code points."""
    key = line.strip(STRIP).lower()  # bytes.lower() leaves all but A-Z alone
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, _text), the id as struct (key, alt); ``alt`` tells rows without a key apart by their text's digest."""
    text = F.col(text_col).cast("binary")
    alt = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text, F.lit(b""))))
    return docs.select(F.struct(F.col(id_col).alias("key"), alt.alias("alt")).alias("id"), text.alias("_text"))


def line_entries(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (h, id), once for each document and key in it; ``id`` as of :func:`named`."""
    src = named(docs, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", SLICE):
            rows, keys = [], []
            for i, raw in enumerate(b.column("_text")):
                raw = raw.as_py() or b""
                found = {line_key(x, min_chars) for x in raw.split(b"\n")} - {None}
                rows += [i] * len(found)
                keys += found
            ids = b.column("id").take(pa.array(rows, pa.int64()))
            hashes = pa.array(keys, pa.binary())
            for s in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([hashes.slice(s, ROWS), ids.slice(s, ROWS)], ["h", "id"])

    # rows of one document may hold a line more than once
    return src.mapInArrow(run, f"h binary, id {kind}").distinct()


class LineRuns:
    """Levelled runs of line hashes; :meth:`add` takes batches of rows (h, id)."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, entries: DataFrame) -> DataFrame:
        """Merge-anti-join a batch with the runs and add what they lack as a run.

        Returns the batch's lines as rows (h, n_docs, keeper, fresh)."""
        own = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        known = None
        for r in self.runs():
            known = r.select("h") if known is None else known.union(r.select("h"))
        if known is None:
            own = own.withColumn("fresh", F.lit(True))
        else:
            own = own.join(known.withColumn("_known", F.lit(True)).hint("merge"), "h", "left")
            own = own.withColumn("fresh", F.col("_known").isNull()).drop("_known")
        own = write_and_reload(own.sortWithinPartitions("h"), "line-run")
        self._place(own.where("fresh").drop("fresh"), 0)
        self.repeats.append(own.where("not fresh").drop("fresh"))
        return own

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self.levels[level][0]
            for r in self.levels[level][1:]:
                merged = merged.union(r)
            self.levels[level] = []
            # runs are disjoint: merging brings rows of a hash range together in order, nothing is summed
            self._place(write_and_reload(merged.repartition("h").sortWithinPartitions("h"), "line-run"), level + 1)

    def totals(self) -> DataFrame:
        """Rows (h, n_docs, keeper) over all batches."""
        rows = None
        for r in [*self.runs(), *self.repeats]:
            rows = r if rows is None else rows.union(r)
        return rows.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def batch_number(docs: DataFrame, id_col: str, batches: int) -> Column:
    """Number of an entry's batch: 0 has the largest ids; those without are in the last."""
    at = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = docs.agg(F.percentile_approx(id_col, at, 10_000)).first()[0] if at else None
    out = F.lit(batches - 1)
    for i, cut in reversed(list(enumerate(cuts or []))):
        out = F.when(F.col("id.key") > F.lit(cut), F.lit(i)).otherwise(out)
    return out


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                        batches: int = 4, fanout: int = 2) -> DataFrame:
    """Lines whose key is in ``min_docs`` or more documents stay only in the document with the largest id.

    A key is the line without the blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower
    case; keys under ``min_chars`` code points are never dropped.  Returns one row per row
    of ``docs``: (key, n_lines, n_dropped, kept), ``kept`` the other lines in UTF-8 bytes,
    joined by a newline.

    * null or empty text: one empty line, which stays;
    * rows with one id are one document: together they count once, and the largest id
      keeps the line in all of its rows; of the rows without an id those with equal texts
      are one document, below all ids, in the order of their texts' digests;
    * a line twice in its keeper stays twice; a document may lose all its lines (``kept`` is empty);
    * very long texts are handled whole: a task holds a few copies of one text;
    * an empty table gives no rows; other columns of ``docs`` are not read.

    A line that a third of all documents hold is one row for each task and batch when
    counted; its documents are told by a sort-merge join whose partitions Spark splits.
    """
    entries = line_entries(docs, id_col, text_col, min_chars).withColumn("batch", batch_number(docs, id_col, batches))
    path = scratch_path(docs.sparkSession, "line-entries")
    entries.write.partitionBy("batch").parquet(path)
    entries = docs.sparkSession.read.schema(entries.schema).parquet(path)  # a table without rows has no files to tell the schema
    index = LineRuns(fanout)
    for i in range(batches):
        index.add(entries.where(F.col("batch") == i).drop("batch"))
    # written, so that the join below has two plain exchanges, of which large partitions can be split
    often = write_and_reload(index.totals().where(F.col("n_docs") >= min_docs).select("h", "keeper"), "line-often")
    gone = entries.join(often, "h").where(F.col("id") != F.col("keeper"))
    gone = write_and_reload(gone.groupBy("id").agg(F.collect_list("h").alias("_gone")), "line-gone")
    rows = named(docs, id_col, text_col).join(gone, "id", "left").select("id.key", "_text", "_gone")
    kind = rows.schema["key"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text", SLICE):
            n_lines, n_dropped, kept = [], [], []
            for raw, drop in zip(b.column("_text"), b.column("_gone")):
                lines = (raw.as_py() or b"").split(b"\n")
                drop = set(drop.as_py() or ())
                stay = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())],
                ["key", "n_lines", "n_dropped", "kept"])
        release()

    return rows.mapInArrow(run, f"key {kind}, n_lines bigint, n_dropped bigint, kept binary")


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id <> o.keeper, false) AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
