"""Tokens and lines as rows, against the forms inside a row and against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.config import ScanConfig
from veilspark.operators import spatial, token_rows
from veilspark.sources.tables import merge_tokens

TEXTS = [
    (1, "Credit card number\n41111111\n11111111\n\nmail a@b.example  now\n"),
    (2, "Card\n4111 1111\n1111\n1111\nOrder\n12345678\n90123456"),
    (3, "Home Address:\n12, Anna Nagar Main Road,\nChennai, Tamil Nadu - 600040\n\n\n\nOffice Address: 7, Lake Street, Chennai 600001\nroad\ncity"),
    (4, None), (5, ""), (6, "   \n x  y \n"), (7, "word " * 3000 + "a@b.example"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string").cache()


def test_tokens_and_lines_are_those_of_the_row_form(spark, texts):
    tokens = token_rows.tokens_of_text(texts, ["id"])
    want = texts.select("id", F.explode(spatial.tokens_from_text(F.coalesce("text", F.lit("")))).alias("t")).select("id", "t.*")
    assert sorted(map(tuple, tokens.select("id", "text", "x", "y", "w", "h").collect())) == sorted(map(tuple, want.select("id", "text", "x", "y", "w", "h").collect()))
    by_id = dict(TEXTS)
    assert all(by_id[r["id"]][r["start"] : r["end"]] == r["text"] for r in tokens.collect())
    described = texts.where("id < 7").select("id", F.posexplode(spatial._described(spatial.tokens_from_text(F.coalesce("text", F.lit(""))))).alias("line", "l"))
    lines = token_rows.lines_of_text(texts.where("id < 7"), ["id"])
    assert sorted(map(tuple, lines.select("id", "line", "text", "x", "y", "w", "h").collect())) == sorted(map(tuple, described.select("id", "line", "l.text", "l.box.*").collect()))


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(1)
    side = lambda n, most: [(rng.choice([1, 1, 1, 2, None]), i, s, s + rng.choice([0, 1, 5, most])) for i in range(n) for s in [rng.randint(0, 3000)]]
    left, right = side(200, 900), side(300, 40)
    frame = lambda rows, name: spark.createDataFrame(rows, f"k int, {name} int, start int, end int")
    got = token_rows.interval_join(frame(left, "a"), frame(right, "b"), ["k"], 64).select("a", "other.b")
    want = [(a, b) for k, a, s, e in left for m, b, t, f in right if k is not None and k == m and s < f and t < e and s < e and t < f]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_boxes_of_spans(spark, texts):
    found = {(r["id"], r["type"]): tuple(r["box"]) for r in token_rows.span_boxes(texts, ["id"], ScanConfig.of(["email"])).collect()}
    pad = 20 * 0.12
    assert found == {(1, "EMAIL"): (50 - pad, 96 - pad, 110 + 2 * pad, 20 + 2 * pad), (7, "EMAIL"): (150_000 - pad, 0.0, 110 + 2 * pad, 20 + 2 * pad)}


def _described_lines(spark, rng, n):
    """Lines of tokens at random places, as rows and as the arrays of the row form."""
    rows = []
    for page in range(n):
        y = 0.0
        for line in range(rng.randint(1, 12)):
            y += rng.choice([4.0, 18.0, 26.0, 30.0, 75.0])
            x, h = float(rng.randint(0, 300)), float(rng.choice([10, 20, 30]))
            text = rng.choice(["Card number", "4111 1111", "11111111", "1111", "41111111", "Aadhaar", "48291736 4926", "x", "12, Lake Road", "Chennai 600001", "city"])
            rows.append((page, line, text, x, y, 10.0 * len(text), h))
    return spark.createDataFrame(rows, "id int, line int, text string, x double, y double, w double, h double")


def test_labels_and_numbers_are_those_of_the_row_form(spark):
    lines = _described_lines(spark, random.Random(4), 60).cache()
    box = F.struct("x", "y", "w", "h")
    words = F.transform(F.split("text", " "), lambda word: F.struct(word.alias("text"), "x", "y", "w", "h", F.lit(0).alias("at")))
    pages = lines.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", F.struct(words.alias("toks"), box.alias("box"), "text").alias("l")))), lambda s: s["l"]).alias("lines")).cache()
    want = pages.select("id", F.posexplode(F.transform("lines", lambda line, i: spatial.label_prefix(F.col("lines"), line, i))).alias("line", "prefix"))
    got = token_rows.label_prefixes(lines, lines, ["id"]).select("id", "line", "prefix")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for band in (7.0, 1000.0):
        again = token_rows.label_prefixes(lines, lines, ["id"], band).select("id", "line", "prefix")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
    cfg = ScanConfig.of(["card", "aadhaar"])
    rows = pages.select("id", F.explode(spatial.dedupe(spatial._across_lines(F.col("lines"), cfg, 0.12, None, None))).alias("d"))
    found = token_rows.distinct_places(token_rows.wrapped_numbers(lines, ["id"], cfg), ["id"])
    flat = lambda df: sorted(map(str, df.select("id", "d.type", "d.value", "d.confidence", "d.box").collect()))
    assert flat(found) == flat(rows) and rows.count() > 5
    blocks = pages.select("id", F.explode(spatial._addresses(F.col("lines"), 0.12, None, None)).alias("d"))
    assert flat(token_rows.address_blocks(lines, ["id"])) == flat(blocks) and blocks.count() > 5


def test_a_long_column_of_numbers_keeps_frames_short(spark):
    lines = spark.range(3000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("line"), F.lit("1234").alias("text"), F.lit(0.0).alias("x"), (F.col("id") * 24.0).alias("y"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h"))
    runs = token_rows.digit_runs(lines, ["id"])
    assert runs.agg(F.max(F.size("frame")), F.count(F.lit(1)), F.countDistinct("run")).first()[:] == (token_rows.NUMBER_LINES, 2999, 1)


def test_addresses_over_lines(spark, texts):
    found = sorted((r["id"], r["line"], r["n"], r["d"]["confidence"]) for r in token_rows.address_blocks(token_rows.lines_of_text(texts, ["id"]), ["id"]).collect())
    assert [(i, line, n) for i, line, n, _ in found] == [(3, 0, 3), (3, 3, 3)] and found[0][3] == 0.99
    best = token_rows.address_windows(texts, ["id"]).collect()
    assert [(r["id"], r["line"], r["n"]) for r in best] == [(3, 0, 3)] and best[0]["value"].startswith("Home Address:\n12, Anna")


def test_uncovered_against_the_row_form(spark):
    rng = random.Random(8)
    token = lambda i: ("t", *map(float, (rng.randint(0, 900), rng.randint(0, 900), rng.choice([0, 5, 60, 300, 900]) if i % 9 else 40_000, rng.choice([0, 20, 80]) if i % 9 else 300)))
    pages = [(k, [token(i) for i in range(40)], [token(i + 1) for i in range(60)]) for k in range(6)] + [(6, [], [token(1)]), (7, [token(1)], [])]
    kind = f"array<{spatial.TOKEN}>"
    df = spark.createDataFrame(pages, f"k int, first {kind}, second {kind}")
    want = df.select("k", F.explode(F.slice(merge_tokens(F.col("first"), F.col("second")), F.size("first") + 1, F.size("second") + 1)).alias("t")).select("k", "t.*")
    rows = lambda name: df.select("k", F.posexplode(name).alias("id", "t")).select("k", "id", "t.*")
    got = token_rows.uncovered(rows("second"), rows("first"), ["k"]).select("k", "text", "x", "y", "w", "h")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 20 < want.count() < 340


def test_empty_tables(spark, texts):
    none = texts.where("false")
    lines = token_rows.lines_of_text(none, ["id"])
    for df in (token_rows.tokens_of_text(none, ["id"]), token_rows.span_boxes(none, ["id"]), token_rows.label_prefixes(lines, lines, ["id"]), token_rows.wrapped_numbers(lines, ["id"]), token_rows.address_blocks(lines, ["id"])):
        assert df.count() == 0
