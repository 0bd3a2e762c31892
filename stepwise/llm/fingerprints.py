"""Document fingerprints: one-permutation MinHash, native expressions only.

Every word shingle is hashed once; its leading bits choose a bin and the rest
compete for the bin's minimum.  Empty bins are filled by optimal densification:
each takes the value of the first non-empty bin in a probe order of its own, so
two texts fill a bin from the same place as often as their shingle sets agree.
The low ``b`` bits of every bin are packed into a hexadecimal string, and the
likeness of two strings is the share of equal bins, corrected for the 2**-b
chance of equal low bits.

Defined results: a null text is empty; a text of fewer words than the shingle
has one shingle, all its words; a text without words has the empty fingerprint,
which is alike (1) to itself and unlike (0) to any other; equal texts have
equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.common import words
from stepwise.session import write_and_reload

#: Bins are addressed by this many leading bits, and hold values of VALUE_BITS bits.
BIN_BITS = 8
VALUE_BITS = 63 - BIN_BITS
EMPTY = (1 << VALUE_BITS) - 1
#: Probes written out before the rest of the probe order is ranked as a whole.
PROBES = 8


def _probe(bin_: int, step: int, bins: int) -> int:
    """Bin looked at by an empty bin in one step (a fixed mixing rule)."""
    x = (bin_ * 0x9E3779B97F4A7C15 + (step + 1) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x ^= x >> 31
    x = x * 0x94D049BB133111EB & (2**64 - 1)
    return (x >> 40) % bins


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(found: Column, n: int) -> Column:
    """63-bit hashes of the ``n``-word shingles of a word array."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    many = _bind(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n),
                                               lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(n)]), 1)))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", found)), 1))
    return F.when(F.size(found) >= n, many).when(F.size(found) > 0, one).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column, n: int = 5, bits: int = 4) -> Column:
    """Packed fingerprint of a text, one hexadecimal digit per bin."""
    if bits != 4:
        raise ValueError("bits must be 4: one hexadecimal digit per bin")
    bins = 1 << BIN_BITS
    # one sentinel per bin: after sorting, the head of each bin is its minimum, or the sentinel of an empty bin
    marks = F.array(*[F.lit((i << VALUE_BITS) | EMPTY) for i in range(bins)])
    probes = F.array(*[F.array(*[F.lit(_probe(i, s, bins)) for s in range(PROBES)]) for i in range(bins)])

    def value(x: Column) -> Column:
        return x.bitwiseAND(F.lit(EMPTY))

    def heads(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(ordered, i - 1), VALUE_BITS)))

    def digits(low: Column) -> Column:
        def look(j: Column, s: int) -> Column:
            seen = value(F.get(low, F.get(F.get(probes, j), F.lit(s))))
            return F.when(seen != EMPTY, seen)

        def rest(j: Column) -> Column:
            """The non-empty bin that comes first in the bin's own random order."""
            filled = F.filter(low, lambda x: value(x) != EMPTY)
            ranked = F.transform(filled, lambda x: F.struct(F.xxhash64(j, F.shiftright(x, VALUE_BITS)).alias("r"), value(x).alias("v")))
            return F.array_min(ranked)["v"]

        def fill(x: Column, j: Column) -> Column:
            return F.when(value(x) != EMPTY, value(x)).otherwise(F.coalesce(*[look(j, s) for s in range(PROBES)], rest(j)))

        return F.array_join(F.transform(low, lambda x, j: F.lower(F.hex(fill(x, j).bitwiseAND(F.lit((1 << bits) - 1))))), "")

    def packed(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.lit("")).otherwise(_bind(_bind(F.sort_array(F.concat(h, marks)), heads), digits))

    return _bind(shingle_hashes(words(text), n), packed)


def likeness(a: Column, b: Column, bits: int = 4) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two fingerprints, 0 to 1."""
    bins, chance = 1 << BIN_BITS, 2.0 ** -bits
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    share = equal.cast("double") / bins
    est = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(est)


def neighbours(keys: DataFrame, order: list[Column], cols: list[str]) -> DataFrame:
    """Every row of ``keys`` with the ``cols`` of the next row in ``order`` as ``next_*``;
    the last row is followed by the first.

    A range partitioning sorts the keys; rows look ahead within their
    partition, and only one row per partition meets in the final look-ahead."""
    parts = write_and_reload(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    pack = F.struct(*cols)
    inner = parts.withColumn("_next", F.lead(pack).over(Window.partitionBy("_part").orderBy(*order)))
    first = (parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
             .where("_r = 1").select("_part", pack.alias("_first")))
    across = Window.orderBy("_part")  # one row per partition
    ring = first.select("_part", F.coalesce(F.lead("_first").over(across), F.first("_first").over(across.rowsBetween(Window.unboundedPreceding, 0))).alias("_ring"))
    out = inner.join(F.broadcast(ring), "_part").withColumn("_next", F.coalesce("_next", "_ring"))
    return out.select(*keys.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in cols])


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text, n_chars, fingerprint, the text with its last third
    replaced from the next document (descending id), that one's fingerprint.

    A document's key is its id and a hash of its text; the order is worked out
    on keys alone, the head a follower must lend is cut before it is shuffled,
    and the exchange of the texts by key serves lending and borrowing."""
    low = -(1 << 63)  # a null id comes last
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("k")).withColumn("h", F.xxhash64("text"))
    ring = neighbours(src.select("k", "h", F.char_length("text").cast("long").alias("n")).distinct(), [F.col("k").desc(), F.col("h").asc()], ["k", "h"])
    lends = ring.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"),
                        F.floor(F.col("n") / 3).cast("int").alias("need"))
    # both uses read the same columns, so one exchange of the texts serves them; a text's fingerprint
    # is worked out once, and goes to the document that borrows and back to its own
    none = F.lit(None).cast("string")

    def sent(fp: Column) -> Column:
        head = F.substring("text", F.lit(1), F.col("need"))
        return F.array(F.struct(F.col("to_k"), F.col("to_h"), head.alias("head"), fp.alias("next_fp"), none.alias("own_fp")),
                       F.struct(F.col("k").alias("to_k"), F.col("h").alias("to_h"), none.alias("head"), none.alias("next_fp"), fp.alias("own_fp")))

    lent = (src.join(lends, ["k", "h"]).select(F.inline(_bind(fingerprint(F.col("text")), sent)))
            .groupBy("to_k", "to_h").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("head", "next_fp", "own_fp")]))
    both = src.join(lent, (src.k == lent.to_k) & (src.h == lent.to_h)).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.col("n_chars").cast("int") - F.floor(F.col("n_chars") / 3).cast("int")
    return both.select(F.when(F.col("k") != low, F.col("k")).alias("id"), "text", "n_chars", F.col("own_fp").alias("fingerprint"),
                       F.concat(F.substring("text", F.lit(1), cut), F.col("head")).alias("edited"), "next_fp")
