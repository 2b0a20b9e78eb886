"""The bound on users' patterns: what it says of patterns, and that costly texts are told apart at once."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.config import ScanConfig, judged_patterns
from veilspark.effort import BUDGET, affordable, effort_of
from veilspark.operators.scan import responses, summaries


@pytest.mark.parametrize(
    ("source", "degree", "narrow"),
    [
        (r"EMP-[0-9]{6}", 1, 0), ("[a-z]{18,}", 1, 0), (r"\w*\w*\w*\w*!", 5, 0), (r"\w+\s+\w+!", 2, 0), (r"\w+\d\w+!", 3, 0), ("a.*b", 2, 0), (r"(?:abc)+(?:ab)+!", 3, 0), ("(a?){25}a{25}", 1, 25), ("(?:a|ab){30}x", 1, 30),
        ("(?:a|b|c){30}x", 1, 0), (r"(\d{1,3}\.){3}\d{1,3}", 1, 1), (r"(\w+\s?){5}!", 6, 1), ("x|y+z", 2, 0), (r"(\w)\1+!", 2, 0), ("", 1, 0), (r"[а-я]+[а-я]+!", 3, 0), (r"(?=\w*x)\w", 2, 0), (r"((\w+)@)?\w+#", 2, 1),
    ],
)
def test_effort_of_patterns(source, degree, narrow):
    found = effort_of(source)
    assert (max([d for d, _ in found.runs], default=1), found.narrow) == (degree, narrow)


@pytest.mark.parametrize("source", [r"\w*\w*!", r"\w*\w*\w*!", r"(?:ab)+(?:ab)+(?:ab)*!", r".*.*x", r"(\w{2,60} ?){2}!", r"a{1,50}b?a{1,50}b?a{1,50}c", r"(?=.*#)\w"])
def test_the_bound_holds_the_steps(source):
    """Time over texts grows no faster than the bound says: both are compared at two lengths, with an engine that goes back as Java's does."""
    degree = max(d for d, _ in effort_of(source).runs)

    def took(n):
        began = time.process_time()
        re.search(source, "ab" * (n // 2))
        return time.process_time() - began

    n = {2: 2000, 3: 300, 4: 120}[degree]
    assert took(2 * n) <= max(0.02, 3 * 2**degree * took(n))


def test_costly_texts_fail_in_time_and_keep_other_detections(spark):
    texts = [(1, "ab" * 10_000 + " mail a@b.example"), (2, "stop! mail a@b.example and go!"), (3, None), (4, "word " * 40_000 + "end!"), (5, "x" * 100)]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    custom = [{"name": "shout", "regex": r"\w*\w*\w*\w*!"}, {"name": "badge", "regex": "EMP-[0-9]{6}"}]
    cfg = ScanConfig.of(["email", "custom"], custom)
    assert [c.name for c in cfg.custom] == ["shout", "badge"]
    summaries(df, ["id"], cfg).collect()
    began = time.monotonic()
    got = {r["id"]: (r["status"], r["total_detections"], r["privacy_score"]) for r in summaries(df, ["id"], cfg).collect()}
    assert time.monotonic() - began < 20
    assert got[1][:2] == ("failed", 1) and got[1][2] <= 50 and got[2][:2] == ("completed", 3) and got[3][:2] == ("completed", 0) and got[4][:2] == ("completed", 1) and got[5][:2] == ("failed", 0)
    told = df.select("id", affordable(F.col("text"), cfg.custom[0].effort).alias("ok"))
    began = time.monotonic()
    assert {r["id"]: r["ok"] for r in told.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False} and time.monotonic() - began < 2
    assert BUDGET == 20_000**2


def test_refused_patterns(spark):
    good, bad = judged_patterns([{"name": "optional", "regex": "(a?){25}a{25}"}, {"name": "forks", "regex": "(?:a|ab){30}x"}, {"name": "fine", "regex": r"\b[A-Z]{2}\d{4,}\b"}, {"name": "open", "regex": "(a"}])
    assert [c.name for c in good] == ["fine"] and dict(bad) == {"optional": "too many choices", "forks": "too many choices", "open": "not a pattern"}


def test_responses_fail_too(spark):
    words = "array<struct<text:string,bbox:array<double>>>"
    row = (1, None, None, "ab" * 10_000 + " a@b.example", None, None, None)
    df = spark.createDataFrame([row], f"id int, tokens {words}, ocr array<struct<text:string,x:double,y:double,w:double,h:double>>, text string, height int, width int, data binary")
    got = responses(df, ["id"], ScanConfig.of(["email", "custom"], [{"name": "s", "regex": r"\w*\w*\w*!"}])).first()
    assert got["status"] == "failed" and got["total_detections"] == 1 and got["privacy_score"] <= 50
