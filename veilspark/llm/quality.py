"""Quality rules whose cutoffs are risk-controlled: labelled holdouts and exact binomial tests bound false rejection per stratum.

Everything here is DataFrame expressions. A rule is "reject when signal >= cutoff". In each stratum (language) and for each
signal, cutoffs are tested from the mildest to the strictest. With n accepted-quality documents in the holdout, of which the
cutoff rejects k, the hypothesis "it rejects more than a share p of good documents" is dismissed when P(Bin(n, p) <= k) is at
most the level. That probability only grows along the sequence, so testing in order needs no correction inside it; over the
strata and signals the level is divided (Bonferroni). With p = alpha / number of signals, all rules of a stratum together
reject more than a share alpha of its good documents with probability at most delta, over all strata at once. Of the
certified cutoffs the one with the best balance of bad to good rejections is taken; a signal without gain has no rule.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, maybe_broadcast

#: White space that separates words: a regular-expression class.
SPACE = r"[ \t-\r]"
#: Bound on the share of good documents that the learned rules of a stratum reject together.
ALPHA = 0.1
#: Probability that the bound fails in any stratum.
DELTA = 0.1
#: Bad documents that must be rejected for each good one.
PRICE = 9

#: Signals, larger is worse; whole numbers, so cutoffs are exact.
SIGNALS = {
    "symbols": "1000 * n_symbols div n_words",
    "repeats": "1000 * n_repeat_words div n_words",
    "dup_lines": "1000 * n_dup_lines div n_lines",
    "long_words": "100 * word_chars div n_words",
    "short_words": "-(100 * word_chars div n_words)",
}


def _repeat_positions(words: Column, n: Column) -> Column:
    """Starts of the 3-word windows found twice or more: sorted (hash, position) longs, equal neighbours compared word by word."""
    bits = F.length(F.bin(n))
    key = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))
    return F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))).otherwise(F.array().cast("array<bigint>"))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base features of every whole text, beside the columns in ``keep``.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed``. Null text has no words; a
    text without words fails the base rule. No shuffle: a row's windows are sorted inside the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep,
        text.alias("_t"),
        F.array_remove(F.split(text, f"{SPACE}+"), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"),
    )
    words, n = F.col("_w"), F.col("_n")
    sized = split.select(
        *keep,
        "_w",
        F.size("_w").alias("_n"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    counted = ["word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    sorted_ = sized.select(*keep, *counted, "_w", "_n", F.length(F.bin("_n")).alias("_b"), _repeat_positions(words, n).alias("_k"))
    keys, bits = F.col("_k"), F.col("_b")

    def at(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        alike = reduce(lambda a, d: a & (F.get(words, at(x) + d) == F.get(words, at(y) + d)), range(3), F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits))
        return F.coalesce(alike, F.lit(False))

    found = sorted_.select(*keep, *counted, "_n", F.sort_array(F.transform(F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1))), at)).alias("_p"))
    starts = F.col("_p")
    covered = F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    done = found.select(*keep, F.col("_n").cast("long").alias("n_words"), *counted, covered.cast("long").alias("n_repeat_words"))
    return done.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series; for arguments above a thousand it is exact to a double's precision."""
    return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


def most_rejected(n: Column, p: float, level: Column) -> Column:
    """The largest k with P(Bin(n, p) <= k) <= level, -1 if there is none: the exact tail, summed up to the mean.

    Large means start 40 standard deviations below it, where the left-out terms are below any double.
    """
    mean = n * p
    first = F.when(mean < 6400, F.lit(0)).otherwise(F.floor(mean - 40 * F.sqrt(mean))).cast("long")
    i = first.cast("double")
    start = F.when(first == 0, n * math.log1p(-p)).otherwise(_log_gamma(n + 1) - _log_gamma(i + 1) - _log_gamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))

    def step(s: Column, j: Column) -> Column:
        total = s["total"] + F.exp(s["term"])
        return F.struct(
            (s["term"] + F.ln((n - j) / (j + 1)) + math.log(p) - math.log1p(-p)).alias("term"),
            total.alias("total"),
            F.when(total <= level, j).otherwise(s["k"]).cast("long").alias("k"),
        )

    zero = F.struct(start.alias("term"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(first, F.floor(mean).cast("long")), zero, step, lambda s: s["k"])


def calibrate(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: int = PRICE) -> DataFrame:
    """Learn the cutoffs: one row per stratum with a cutoff column per signal, null where the signal has no rule.

    found: features with doc_id and stratum. labels: doc_id and quality (1 good, 0 bad); null labels are left out, and a
    document with several labels is good if all are. The holdout is every labelled document that passes the base rule.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).cast("long").alias("_good"))
    held = found.where("NOT base_failed").join(marks, "doc_id")
    signals = F.explode(F.map_from_arrays(F.array(*map(F.lit, SIGNALS)), F.array(*[F.expr(f"CAST({e} AS BIGINT)") for e in SIGNALS.values()])))
    values = held.select("stratum", "_good", signals.alias("signal", "value"))
    counts = durable(values.groupBy("stratum", "signal", "value").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")))
    sizes = counts.groupBy("stratum", "signal").agg(F.sum("good").alias("n"))
    tests = F.greatest(F.lit(1), F.count(F.lit(1)).over(Window.partitionBy()))
    limits = sizes.select("stratum", "signal", most_rejected(F.col("n").cast("double"), alpha / len(SIGNALS), F.lit(delta) / tests).alias("most"))
    worst_first = Window.partitionBy("stratum", "signal").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    tried = counts.select("stratum", "signal", "value", F.sum("good").over(worst_first).alias("k"), F.sum("bad").over(worst_first).alias("hits"))
    gain = F.col("hits") - price * F.col("k")
    chosen = tried.join(limits, ["stratum", "signal"]).where((F.col("k") <= F.col("most")) & (gain > 0)).groupBy("stratum", "signal").agg(F.max_by("value", F.struct(gain, "value")).alias("cutoff"))
    return chosen.groupBy("stratum").pivot("signal", list(SIGNALS)).agg(F.first("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features and verdict of every document: the columns in ``keep``, the base features and ``kept``.

    docs needs doc_id, text and lang; its language is the stratum (null is a stratum of its own, apart from the empty string). Strata with
    too few good labels to certify anything have no learned rule, so there the base rule alone decides; the same holds without labels.
    Null, empty and short texts fail the base rule; texts are read whole; repeated rows have one verdict and each count in a holdout if
    their id is labelled; an empty table gives no rows. Columns in ``keep`` may have any name; the others are ignored.
    """
    # Columns to keep travel under numbers, so that no name of theirs meets one of ours.
    own = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("stratum")
    kept = [f"_k{i}" for i in range(len(keep))]
    cut = docs.select(*own, F.col("doc_id").cast("long").alias("_id"), "text", stratum)
    found = durable(features(cut, (*kept, "_id", "stratum")))
    rules = durable(calibrate(found.drop(*kept).withColumnRenamed("_id", "doc_id"), labels, alpha, delta))
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.expr(e) >= F.col(f"_r.{s}"), F.lit(False)) for s, e in SIGNALS.items()])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = found.join(maybe_broadcast(rules.withColumnRenamed("stratum", "_s")).alias("_r"), F.col("stratum") == F.col("_r._s"), "left")
    return judged.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *base, F.when(F.col("base_failed"), False).otherwise(~bad).alias("kept"))
