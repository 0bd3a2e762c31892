"""Quality classifier: a sparse rule ensemble compiled into Column expressions.

Statistics of each text are native expressions.  A shallow forest grown on
labelled rows yields tree paths, each a conjunction of thresholds on
statistics; lasso-penalised logistic regression weighs the rules, and those
left with a weight are compiled into one score expression that Spark evaluates
for every document.

The fit reads at most ``MAX_TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id; statistics and scores cover every row.

Defined results: a null or empty text has all statistics 0 and is scored like
any other; without labelled rows the score is 0.5; with one label class only,
the score is that label's smoothed share; a row labelled more than once counts
as often; rows without a label do not train; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import BLANKS, held_out, words
from stepwise.llm.quality_rules import STOP_WORDS, SYMBOLS
from stepwise.session import write_and_reload

#: Bound on the labelled rows that the forest and the lasso see.
MAX_TRAIN_ROWS = 40_000
FEATURES = ("log_words", "mean_word_chars", "symbol_share", "upper_share", "digit_share", "mark_share", "bar_share",
            "dup_line_share", "distinct_word_share", "doubled_word_share", "stop_word_share", "words_per_line")


def statistics(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` plus the columns of FEATURES, from ``text_col`` alone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def count(regex_class: str) -> Column:
        return F.char_length(text) - F.char_length(F.regexp_replace(text, regex_class, ""))

    def without(chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    upper = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÎÏÍÑÓÔÖÙÚÛÜ", ""))
    base = (df.withColumn("_w", words(F.col(text_col).cast("string")))
            .withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
            .withColumn("_n", F.size("_w").cast("double")).withColumn("_ln", F.size("_l").cast("double"))
            .withColumn("_chars", F.char_length(F.translate(text, BLANKS, "")).cast("double"))
            .withColumn("_symbols", without(SYMBOLS.replace("|", ""))).withColumn("_upper", upper)
            .withColumn("_digits", without("0123456789")).withColumn("_marks", without("!?")).withColumn("_bars", without("|"))
            .withColumn("_doubled", F.size(F.filter("_w", lambda w, i: w == F.get(F.col("_w"), i - 1))))
            .withColumn("_stops", F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS)))))

    def share(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))

    return (base.withColumn("log_words", F.log1p("_n")).withColumn("mean_word_chars", share(F.col("_chars"), "_n"))
            .withColumn("symbol_share", share(F.col("_symbols"), "_chars")).withColumn("upper_share", share(F.col("_upper"), "_chars"))
            .withColumn("digit_share", share(F.col("_digits"), "_chars")).withColumn("mark_share", share(F.col("_marks"), "_chars"))
            .withColumn("bar_share", share(F.col("_bars"), "_n")).withColumn("dup_line_share", share(F.col("_ln") - F.size(F.array_distinct("_l")), "_ln"))
            .withColumn("distinct_word_share", share(F.size(F.array_distinct("_w")).cast("double"), "_n"))
            .withColumn("doubled_word_share", share(F.col("_doubled"), "_n")).withColumn("stop_word_share", share(F.col("_stops"), "_n"))
            .withColumn("words_per_line", share(F.col("_n"), "_ln"))
            .drop("_w", "_l", "_n", "_ln", "_chars", "_symbols", "_upper", "_digits", "_marks", "_bars", "_doubled", "_stops"))


#: One condition: feature, whether the bound is an upper one (<=), threshold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions and an intercept; ``score`` is their logistic."""
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        z = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [(F.col(f) <= F.lit(t)) if up else (F.col(f) > F.lit(t)) for f, up, t in conditions])
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_paths(debug: str, features: tuple[str, ...]) -> list[tuple[Condition, ...]]:
    """Every path of a tree from its root, inner nodes included, as simplified conjunctions."""
    out: list[tuple[Condition, ...]] = []
    stack: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        m = re.match(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (features[int(m[2])], m[3] == "<=", float(m[4]))))
        bounds: dict[tuple[str, bool], float] = {}
        for _, (f, up, t) in stack:  # the tightest bound of each kind
            old = bounds.get((f, up))
            bounds[f, up] = t if old is None else (min(old, t) if up else max(old, t))
        out.append(tuple(sorted((f, up, t) for (f, up), t in bounds.items())))
    return out


def fit(train: DataFrame, label_col: str, trees: int = 8, depth: int = 3, reg: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on ``train`` (FEATURES and a 0/1 label), a bounded table."""
    have = {r["y"]: r["n"] for r in train.groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    n0, n1 = have.get(0, 0), have.get(1, 0)
    if not n0 or not n1:
        from math import log
        return RuleModel((), 0.0 if not n0 + n1 else log((n1 + 0.5) / (n0 + 0.5)))
    # both classes weigh the same, so that 0.5 parts them whatever their shares
    weight = F.when(F.col(label_col) == 1, F.lit((n0 + n1) / (2.0 * n1))).otherwise(F.lit((n0 + n1) / (2.0 * n0)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(
        train.where(F.col(label_col).isin(0, 1)).withColumn("_y", F.col(label_col).cast("double")).withColumn("_weight", weight)).persist()
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="6", subsamplingRate=0.8).fit(rows)
    rules = list(dict.fromkeys(p for t in forest.trees for p in tree_paths(t.toDebugString, FEATURES)))
    if not rules:
        rows.unpersist()
        return RuleModel((), 0.0)
    flags = rows.select("_y", "_weight", *[
        reduce(lambda a, b: a & b, [(F.col(f) <= F.lit(t)) if up else (F.col(f) > F.lit(t)) for f, up, t in r]).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_r").transform(flags).select("_y", "_weight", "_r").persist()
    lasso = LogisticRegression(labelCol="_y", featuresCol="_r", weightCol="_weight", elasticNetParam=1.0, regParam=reg, maxIter=60, standardization=False).fit(flags)
    rows.unpersist()
    flags.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9)
    return RuleModel(kept, float(lasso.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality",
                  max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score): every document scored by rules learnt from the labels
    of documents that are not held out."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = write_and_reload(statistics(src, "text").drop("text").withColumn("held_out", held_out(F.col("id"))), "quality-stats")
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    train = (stats.where(~F.col("held_out")).join(known, "id").select("id", "y", *FEATURES)
             .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    train = write_and_reload(train, "quality-train")
    return stats.select("id", "held_out", fit(train, "y").score().alias("score"))
