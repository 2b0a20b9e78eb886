"""Names that clash, nulls apart from empty strings, and what a plain version says of the learned rules."""

import math
import random

from pyspark.sql import functions as F

from brute import WORD, features
from veilspark.llm import quality


def test_quality_keeps_columns_of_any_name_and_nulls_apart(spark):
    good = "word one two three " * 3
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), None if i % 2 else "", i, "s", 3) for i in range(20)] + [(50, good, "", 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, stratum string, `a.b` int")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    got = quality.judge(docs, labels, keep=("doc_id", "n_words", "stratum", "a.b"))
    assert got.columns[:4] == ["doc_id", "n_words", "stratum", "a.b"] and got.count() == 21
    found = quality.features(docs.select("text", F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum")), ("_id", "stratum"))
    assert {r[0] for r in found.select("stratum").distinct().collect()} == {"", "="}


def binomial_most(n, p, level):
    """The largest k for which at most k of n has a chance of ``level`` or less, -1 if there is none."""
    total, most = 0.0, -1
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > level:
            break
        most = k
    return most


def plain_rules(docs, labels):
    """For each (language, signal) the cutoff by the same rule, with whole sums."""
    values = {}
    for i, text, lang in docs:
        f = features(text)
        if f["base_failed"] or i not in labels:
            continue
        for name, value in signals_of(text).items():
            values.setdefault((lang, name), []).append((value, labels[i]))
    rules = {}
    for key, held in values.items():
        n = sum(q for _, q in held)
        most = binomial_most(n, quality.ALPHA / len(quality.SIGNALS), quality.DELTA / len(values))
        best = None
        for value in sorted({v for v, _ in held}, reverse=True):
            k, hits = sum(q for v, q in held if v >= value), sum(1 - q for v, q in held if v >= value)
            gain = hits - quality.PRICE * k
            if k <= most and gain > 0:
                best = max(best or (gain, value), (gain, value))
        if best:
            rules[key] = best[1]
    return rules


def signals_of(text):
    f = features(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    long = 100 * f["word_chars"] // f["n_words"]
    return {"symbols": 1000 * f["n_symbols"] // f["n_words"], "repeats": 1000 * f["n_repeat_words"] // f["n_words"], "dup_lines": 1000 * f["n_dup_lines"] // lines, "long_words": long, "short_words": -long}


def test_kept_against_plain_rules(spark):
    rng = random.Random(4)
    docs, labels = [], {}
    for i in range(1500):
        bad = i % 5 == 0
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60 + rng.randint(0, 20))]
        text = " ".join(w + (" #$%" if bad and rng.random() < 0.5 else "") for w in words) + ("\nsame line\nsame line" if rng.random() < 0.1 else "")
        docs.append((i, text, rng.choice(["en", None])))
        if i % 10 != 9:
            labels[i] = 0 if bad else 1
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    rules = plain_rules(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table, marks).collect()}
    want = {}
    for i, text, lang in docs:
        f = features(text)
        want[i] = not f["base_failed"] and not any((lang, s) in rules and v >= rules[lang, s] for s, v in signals_of(text).items())
    assert got == want and 280 < sum(not k for k in got.values()) < 320
