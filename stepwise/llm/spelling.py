"""Spelling variant grouping by permuterm rotations.

A word is closed by a terminator and turned: ``word$`` has the rotations
``word$``, ``ord$w``, ``rd$wo`` and so on.  Where a rotation ends in the
edited letter, the prefix in front of it holds all the rest of the word:
words that differ from it by that letter alone have rotations with the same
prefix and one more letter, and the word without the letter has this prefix
as a whole rotation.  So the rotations are sorted by that prefix, and each run
of equal prefixes is one group of neighbours.

A group holds at most one member for each letter of the alphabet and one word
without.  Nothing is paired: a member's best neighbour is the first of its
group's order, or the second for the first itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.common import release, slices
from stepwise.session import write_and_reload

#: Letters of a word after lower-casing A-Z; the terminator is none of them.
LETTER = "a-zÀ-ÿ"
END = "$"
#: Texts handed to Python, and parts of one text searched for words, at a time, in bytes or characters.
SLICE = 4 << 20
#: Words a task counts before it hands the counts on.
HELD = 300_000
#: One in so many words of a text loses a letter.
EVERY = 97


def text_words(text: str, min_chars: int) -> Counter:
    """Counts of the maximal runs of letters with ``min_chars`` or more, read window by window."""
    word, other = re.compile(f"[{LETTER}]{{{min_chars},}}"), re.compile(f"[^{LETTER}]")
    out: Counter = Counter()
    at = 0
    while at < len(text):
        m = other.search(text, at + SLICE)
        end = m.start() if m else len(text)
        out.update(word.findall(text, at, end))
        at = end
    return out


def spelled(doc_id, counts: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document as they are spelled: where 97 divides the crc32 h of
    ``<doc_id>:<word>``, code point h % length is left out."""
    front = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in counts.items():
        h = zlib.crc32(w.encode(), front)
        if h % EVERY == 0:
            i = h % len(w)
            w = w[:i] + w[i + 1:]
        yield w, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """Rows (word, n) of the words with ``min_chars`` or more code points, found ``min_count`` times or more."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in slices(batches, "_text", SLICE):
            for key, raw in zip(b.column("id").to_pylist(), b.column("_text")):
                text = (raw.as_py() or b"").lower().decode()  # bytes.lower() leaves all but A-Z alone
                for w, n in spelled(key, text_words(text, min_chars)):
                    if len(w) >= min_chars:
                        held[w] += n
                if len(held) > HELD:
                    yield handed()
        yield handed()
        release()

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """Rotations of each word by the prefix that groups them: rows (prefix, kind, rank, word, once).

    kind 0: the rotation but its last letter, the edited one; ``once`` is false where the
    letter repeats the one before it, as leaving out either gives the same word.
    kind 1: the whole rotation.  ``rank`` orders words by falling n, then by code points."""
    rank = F.struct((-F.col("n")).alias("neg"), "word").alias("rank")
    size = F.char_length("word")
    i = F.col("i")
    turned = words.select("word", rank, F.explode(F.sequence(F.lit(0), size)).alias("i"))
    whole = turned.select(F.concat(F.expr("substring(word, i + 1)"), F.lit(END), F.expr("substring(word, 1, i)")).alias("prefix"),
                          F.lit(1).alias("kind"), "rank", "word", F.lit(True).alias("once"))
    part = turned.where(i > 0).select(F.concat(F.expr("substring(word, i + 1)"), F.lit(END), F.expr("substring(word, 1, i - 1)")).alias("prefix"),
                                      F.lit(0).alias("kind"), "rank", "word",
                                      ((i == 1) | F.expr("substring(word, i, 1) != substring(word, i - 1, 1)")).alias("once"))
    return whole.union(part)


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (word, n_near, best) of the words that have neighbours: words one inserted,
    deleted or replaced code point away; ``best`` is (-n, word) of the first by falling n, then code points."""
    group = Window.partitionBy("prefix").orderBy("kind", "rank")
    over = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member, once = F.col("kind") == 0, (F.col("kind") == 0) & F.col("once")
    g = rotations(words).select(
        "word", "kind", "once", F.row_number().over(group).alias("_at"),
        F.count(F.lit(1)).over(over).alias("_rows"), F.sum(member.cast("int")).over(over).alias("_members"), F.sum(once.cast("int")).over(over).alias("_once"),
        F.first("rank").over(over).alias("_first"), F.nth_value("rank", 2).over(over).alias("_second"),
        F.first(F.when(once, F.col("rank")), ignorenulls=True).over(over).alias("_first_once"),
        F.last(F.when(~member, F.col("rank")), ignorenulls=True).over(over).alias("_whole")).where("_rows > 1")
    base = once & F.col("_whole").isNotNull()
    other = F.when(F.col("_members") > 1, F.when(F.col("_at") == 1, F.col("_second")).otherwise(F.col("_first")))
    near = F.when(member, F.col("_members") - 1 + base.cast("int")).otherwise(F.col("_once"))
    best = F.when(member, F.least(other, F.when(base, F.col("_whole")))).otherwise(F.col("_first_once"))
    out = g.select("word", near.cast("long").alias("n_near"), best.alias("best")).where("n_near > 0")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from links (word, form): the last word reached.  Links rise in n
    by a factor of two or more, so there are no rings, and doubling the reach of each
    link ends after as many rounds as the longest chain has binary digits."""
    e = write_and_reload(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = e.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not e.join(ahead, "root", "left_semi").limit(1).count():
            return e
        e = write_and_reload(e.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Words of all texts with the more frequent word that each is a variant of.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, as
    :func:`spelled`.  Returns (word, form, root, n, n_near, form_n): ``form`` is the near
    word of largest n (ties: the smallest by code points) if that is ``ratio`` times the
    word's n or more, else null; ``root`` follows forms to the last.

    * null or empty text, or one without letters: no words;
    * null id: stands as the empty string in front of the colon;
    * repeated rows count each; other columns are not read; an empty table gives no rows;
    * very long texts are searched window by window, a task holds the distinct words of one text;
    * a word of any length is one word; it has as many rotations as letters.
    """
    words = write_and_reload(word_counts(docs, id_col, text_col, min_chars, min_count), "words")
    near = words.join(neighbours(words), "word", "left")
    up = F.when(-F.col("best.neg") >= ratio * F.col("n"), F.col("best"))
    near = write_and_reload(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), up["word"].alias("form"),
                                        (-up["neg"]).alias("form_n")), "variants")
    roots = follow(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
found AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS hx FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hx) + 1, 2), lambda j: ('0x' || hx[j:j + 1])::BIGINT)),
                                                      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM found, tab),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, i, word[1:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.a || c.b
         UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.a || c.b),
best AS (SELECT near.word, count(*) AS n_near, arg_min(struct_pack(w := o.word, m := o.n), struct_pack(k := -o.n, w := o.word)) AS top
         FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 2 * words.n THEN top.w END AS form,
                 CASE WHEN top.m >= 2 * words.n THEN top.m END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, reached, further) AS (SELECT word, word, form FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.further)
SELECT forms.word, forms.form, walk.reached AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN walk USING (word) WHERE walk.further IS NULL
"""
