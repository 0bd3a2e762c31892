"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is folded to lower case with runs of non-letters as one blank, and
its character n-grams (1 to 3) are hashed to a fixed number of buckets.  Training is
one counting pass over all training texts, summed by Spark; the smoothed
log-probability matrix (buckets x languages) is broadcast, and a batch of texts
is scored in numpy from its sparse (text, bucket, count) entries.

Defined results: a text that is null or has no letter is ``und`` with score 0;
a training row without a language or without letters teaches nothing; without
any training row everything is ``und``; ties go to the first language by
name; repeated rows count as often as they occur; an empty table gives no rows.
A very long text is counted in windows, whole: beside the text and its lower-case
copy, memory does not grow with it.  A text's result does not depend on the texts
it is scored with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import share, slices, worker_cache

#: Bytes of text counted or scored together; a longer text stands alone.
SLICE = 1 << 20
#: Code points hashed at a time; numpy needs about 150 bytes for each for a moment.
WINDOW = 1 << 18
#: More languages than this are refused: the driver collects 16 bytes for each bucket of a
#: language (134 MB at the default 2**15 buckets), and the broadcast holds 4.
MAX_LANGUAGES = 256


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    def make():
        return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return worker_cache("letters", make)


def ngram_buckets(texts: list[str], buckets: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram of every text, window by window; rows without letters have none.

    A text stands between two edges, which count as blanks, and a run of non-letters
    inside of it is one blank.  The last code points of a window, folded, go before the next."""
    # U+0000 marks the edges, so that no n-gram spans two texts
    flat = "\x00" + "\x00".join(t.lower().replace("\x00", " ") for t in texts) + "\x00"
    letters, longest = _letters(), max(orders)
    held = np.empty(0, np.uint32)  # folded code points: letters, 32, 0 for an edge
    row = 0  # edges in front of held
    fresh = 0  # how many of held have ended n-grams already
    for at in range(0, len(flat), WINDOW):
        code = np.frombuffer(flat[at:at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.r_[held, np.where(letters[code] | (code == 0), code, 32).astype(np.uint32)]
        # the first blank of a run stays, unless it touches an edge
        blank = code == 32
        drop = np.r_[False, blank[1:] & (blank[:-1] | (code[:-1] == 0))]
        code = code[~drop]
        blank = code == 32
        drop = np.r_[blank[:-1] & (code[1:] == 0), False]
        code = code[~drop]
        # a blank at the end may still meet an edge
        wait = 1 if len(code) and code[-1] == 32 and at + WINDOW < len(flat) else 0
        body = code[:len(code) - wait]
        edge = body == 0
        rows = row + np.cumsum(edge) - 1
        is_letter = ~edge & (body != 32)
        value = np.where(edge, 32, body).astype(np.uint64)
        for n in orders:
            first = max(0, fresh - n + 1)  # n-grams that end in what is new
            size = len(body) - n + 1 - first
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            some, apart = np.zeros(size, bool), np.zeros(size, bool)
            for i in range(n):
                own = slice(first + i, first + i + size)
                h = (h ^ value[own]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                some |= is_letter[own]
                if 0 < i < n - 1:
                    apart |= edge[own]
            ok = some & ~apart
            yield (h[ok] % np.uint64(buckets)).astype(np.int64), rows[first:first + size][ok]
        cut = max(0, len(body) - longest + 1)
        row += int(edge[:cut].sum())
        fresh = len(body) - cut
        held = code[cut:]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    orders: tuple[int, ...]


def train(df: DataFrame, text: Column, lang: Column, buckets: int = 1 << 15, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5) -> LanguageModel:
    """Count hashed n-grams by language over every row of ``df``."""
    src = df.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in slices(batches, "text", SLICE):
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
            names, code = np.unique(langs.astype(str), return_inverse=True)
            told = np.zeros(len(texts), bool)  # rows with a letter
            for bucket, row in ngram_buckets(texts, buckets, orders):
                told[row] = True
                own = code[row]
                for i in np.unique(own).tolist():
                    mine = counts.setdefault(names[i], np.zeros(buckets, np.int64))
                    mine += np.bincount(bucket[own == i], minlength=buckets)
            if len(counts) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            for i, k in enumerate(np.bincount(code[told], minlength=len(names)).tolist()):
                docs[names[i]] = docs.get(names[i], 0) + k
        for name, c in counts.items():
            at = np.flatnonzero(c)
            k = np.r_[at, -1]  # bucket -1 holds the number of texts
            n = np.r_[c[at], docs[name]]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.astype(np.int64)), pa.array(n)], ["lang", "bucket", "n"])

    sums = src.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))  # at most buckets + 1 entries
    got = by_lang.select("lang", "c.bucket", "c.n").orderBy("lang").limit(MAX_LANGUAGES + 1).toArrow()  # arrays, no row objects
    if got.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the driver would not hold the counts")
    names, m, prior = got.column("lang").to_pylist(), np.zeros((buckets, got.num_rows)), np.zeros(got.num_rows)
    for j in range(got.num_rows):
        at, n = (got.column(c)[j].values.to_numpy() for c in ("bucket", "n"))
        prior[j] = n[0]  # bucket -1 sorts first
        m[at[1:], j] = n[1:]
    log_prob = (np.log(m + alpha) - np.log(m.sum(0) + alpha * buckets)).astype(np.float32) if names else np.zeros((buckets, 0), np.float32)
    return LanguageModel(tuple(names), log_prob, np.log(prior / prior.sum()) if names else np.zeros(0), orders)


def score(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    size, pred, conf = len(model.log_prob), ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return pred, conf
    # sparse entries: a row and a bucket with their count
    entry, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for bucket, row in ngram_buckets([t or "" for t in texts], size, model.orders):
        new, k = np.unique(row * size + bucket, return_counts=True)
        entry, at = np.unique(np.r_[entry, new], return_inverse=True)
        n = np.bincount(at, np.r_[n, k], len(entry)).astype(np.int64)
    r, b = np.divmod(entry, size)
    # one language at a time, so memory does not grow with their number; each row is summed by bucket, alone or in a batch
    logs = np.stack([np.bincount(r, model.log_prob[b, j].astype(np.float64) * n, len(texts)) for j in range(len(model.languages))], 1) + model.log_prior
    best = logs.argmax(1)
    post = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
    for i in np.unique(r).tolist():
        pred[i], conf[i] = model.languages[best[i]], post[i]
    return pred, conf


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns of ``df`` with ``lang_pred`` and ``score``, which stand in place of kept ones of that name."""
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    cols = [F.col(c) for c in keep]
    src = df.select(F.col(text_col).cast("string").alias("_text"), *cols)
    shared = share(df.sparkSession, model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", SLICE):
            pred, conf = score(shared(), b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(conf)], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, (fields + ", " if fields else "") + "lang_pred string, score double")
