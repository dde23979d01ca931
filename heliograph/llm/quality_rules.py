"""Quality rules: a decision list learned by sequential covering. DataFrame functions only.

Statistics of every text come from array functions inside the row. Rules are
conjunctions of thresholds on them, each grown one condition at a time by
FOIL's gain on two thirds of the labelled rows and pruned on the other third;
what a rule covers is then set aside and the next one is learned. Each step is
one aggregation to (statistic, bin) counts, which is all that the driver sees.
The list is applied as one ordered chain of conditional expressions.

Parameters: thresholds are tried at the BINS-quantiles of all labelled rows and
of the bad ones. A rule grows until no condition gains, or it covers bad rows
alone. The list grows until the next rule would be right less often than
MIN_PRECISION on the rows kept for pruning, or cover less of the bad ones than
MIN_SHARE (and MIN_COVER rows at least); `max_rules` and `max_conditions` end it
earlier if they are given.

Defined results: a null text counts as empty, an empty one has no words and
fails the base rule; labels that are null, repeated with conflict or without a
document are not learned from; without labels of both kinds there are no rules
and the base rule decides alone. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged, table
from .text import SPACE, columns, fold, whole, words

BINS = 16
MIN_PRECISION = 0.9
MIN_COVER = 20
MIN_SHARE = 0.002
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "letter_share")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five base statistics and the shares that the rules look at."""
    get = F.get
    d = columns(docs, doc_id="long", text="string").select("doc_id", whole(F.col("text")).alias("t"))
    d = d.withColumns({"w": words(F.col("t")), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # Each 3-word window as (hash, place); sorting brings equal windows together.
    window = F.transform("w", lambda x, i: F.struct(F.xxhash64(x, get("w", i + 1), get("w", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("n_words", F.size("w").cast("long")).withColumn("s", F.sort_array(F.slice(window, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))))
    again = F.transform(F.filter("s", lambda x, i: (x["h"] == get("s", i - 1)["h"]) | (x["h"] == get("s", i + 1)["h"])), lambda x: x["i"])
    d = d.withColumn("p", F.sort_array(again))
    # Windows overlap: each adds the words up to the next one, three at most.
    steps = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(get("p", i + 1) - x, F.lit(3))))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    d = d.select(
        "doc_id",
        "n_words",
        (F.length("t") - count(SPACE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count(r"[!-/:-@\[-`{-~]").alias("n_marks"),
        count(r"\p{L}").alias("n_letters"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", per("word_chars", "n_words").alias("word_length"), per("n_symbols", "n_words").alias("symbol_share"), per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"), per("n_upper", "word_chars").alias("upper_share"), per("n_digits", "word_chars").alias("digit_share"), per("n_marks", "word_chars").alias("mark_share"), per("n_letters", "word_chars").alias("letter_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]


def holds(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) > t if op == ">" else F.col(f) <= t for f, op, t in rule])


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """By feature, (bad, good) of each bin; bins are few, so this is small whatever the input."""
    bins = [F.struct(F.lit(f).alias("f"), reduce(lambda a, b: a + b, [(F.col(f) > t).cast("int") for t in cs]).alias("b")) for f, cs in cuts.items() if cs]
    got = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n"))
    out = {f: [(0, 0)] * (len(cs) + 1) for f, cs in cuts.items()}
    for r in got.collect():
        out[r["f"]][r["b"]] = (r["p"], r["n"] - r["p"])
    return out


def learn(labelled: DataFrame, max_rules: int | None = None, max_conditions: int | None = None) -> list[list[Condition]]:
    """labelled: FEATURES, bad (1: low quality), prune (the third kept for pruning)."""
    total = labelled.agg(F.sum("bad").alias("p"), F.count("*").alias("n"), *[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10000).alias(f) for f in FEATURES]).first()
    if not total["p"] or total["p"] == total["n"]:
        return []
    # The tails of rare junk lie beyond the quantiles of all rows, so those of the bad rows cut too.
    tails = labelled.where("bad = 1").agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({*total[f], *tails[f]}) for f in FEATURES}
    cover = max(MIN_COVER, MIN_SHARE * total["p"])
    rules: list[list[Condition]] = []
    left = labelled
    while max_rules is None or len(rules) < max_rules:
        rule: list[Condition] = []
        while max_conditions is None or len(rule) < max_conditions:
            grow = left.where(~F.col("prune"))
            counts = _counts(grow.where(holds(rule)) if rule else grow, cuts)
            p0, n0 = (sum(x) for x in zip(*next(iter(counts.values()))))
            if not p0 or p0 >= 0.995 * (p0 + n0):
                break
            best, found = 0.0, None
            for f, cs in cuts.items():
                p = n = 0
                for (bp, bn), t in zip(counts[f], cs):
                    p, n = p + bp, n + bn
                    for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                        gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0))) if a >= cover / 2 else 0.0
                        if gain > best:
                            best, found = gain, (f, op, t)
            if not found:
                break
            rule.append(found)
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        row = left.where("prune").agg(*[F.coalesce(F.sum(F.when(holds(r), x)), F.lit(0)).alias(f"{k}{i}") for i, r in enumerate(prefixes) for k, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((row[f"p{i}"] - row[f"n{i}"]) / max(1, row[f"p{i}"] + row[f"n{i}"]), -i) for i in range(len(prefixes))]
        i = -max(worth)[1]
        p, n = row[f"p{i}"], row[f"n{i}"]
        if p + n < cover / 2 or p < MIN_PRECISION * (p + n):
            break
        rules.append(prefixes[i])
        left = left.where(~holds(prefixes[i]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(holds(rules[k - 1]), k).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document, base_failed, the rule that rejects it (0: none) and kept."""
    stats = staged(statistics(docs), "rules-statistics")
    marked = columns(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2 and q in (0, 1)")
    labelled = staged(stats.where(~base_failed()).join(marked, "doc_id").select(*FEATURES, (1 - F.col("q")).alias("bad"), (fold(F.col("doc_id"), 3) == 0).alias("prune")), "rules-labelled")
    rules = learn(labelled)
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
