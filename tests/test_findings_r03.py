"""One test for each finding of the third round."""

import collections

import duckdb
import pytest

from veilspark.plans.queries import ORACLES, QUERIES


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def against_sql(spark, name, folder, tables):
    """The rows of a query and of its SQL over tables made for a test, as counters."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    cur = con.execute(ORACLES[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = collections.Counter(tuple(plain(row[i]) for i in at) for row in cur.fetchall())
    return collections.Counter(tuple(plain(r[n]) for n in names) for r in QUERIES[name](spark, str(folder)).collect()), want


def test_f1_numbers_in_labels_count_as_often_as_the_sql_finds_them(spark, tmp_path):
    # doc_id % 5 == 4 has nothing laid below it
    text = "Ref 4497672581733027 and 4497672581733027 so\nCredit card number\n41111111\n11111111"
    got, want = against_sql(spark, "wrapped_numbers", tmp_path, {"documents": ([(4, text), (9, "none")], "doc_id long, text string")})
    assert got == want and sum(got.values()) == 3


def _tasks(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions()


#: Queries that work row by row, by finding: a table in one split must be dealt to more tasks than twice the cores.
DEALT = {"f2": "image_responses", "f3": "redacted_messages", "f4": "ocr_requests", "f8": "image_attempts", "f11": "scan_pages", "f14": "located_cards", "f15": "client_boxes"}


@pytest.mark.parametrize("finding", DEALT)
def test_rows_of_one_split_are_dealt_to_many_tasks(spark, finding):
    assert _tasks(spark, DEALT[finding]) >= 4 * spark.sparkContext.defaultParallelism


def test_f8_short_sides_are_blurred_by_one_product():
    import numpy as np

    from veilspark.operators import images

    pixels = np.random.default_rng(3).integers(0, 255, (6, 90, 3)).astype(float)
    images._weights.cache_clear()
    got = images.blur(pixels, 8.0)
    assert images._weights.cache_info().misses == 1  # 90 pixels are more than the 49 of the kernel
    reach, kernel = 24, images._kernel(8.0)
    padded = np.pad(pixels, ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    want = sum(a * b * padded[i : i + 6, j : j + 90] for i, a in enumerate(kernel) for j, b in enumerate(kernel))
    assert np.abs(got - want).max() < 1e-9


def test_f10_f12_f13_words_of_addresses_are_those_that_the_text_contains(spark):
    from pyspark.sql import functions as F

    from veilspark.functions.text import plain, trie
    from veilspark.operators import scoring

    texts = ["HOUSE \t\n NO 5", "tamil  NADU", "pin\x1fcode", "villages", "have", "Kerala", "st", "st.", "x  y", "", "Bihar\x85 zip  code"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.withColumn("said", scoring.address_words(F.col("text"))).select("said", plain(F.col("text")).alias("n"), F.lower("text").rlike(trie(scoring._CUES)).alias("cue")).collect()
    for r in rows:
        assert {t for t in scoring._SHORT if t in r["n"]} == set(filter(None, r["said"].split("|"))) and r["cue"] == any(t in r["n"] for t in scoring._CUES)


def test_f6_effort_is_counted_once(spark):
    plan = QUERIES["pattern_effort"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{18,}+") == 1 and plan.count("{1,}+") == 1


def test_f5_f7_f9_lines_are_made_by_many_tasks_and_labelled_where_they_can_hold_something(spark):
    from pyspark.sql import functions as F

    from veilspark.config import ScanConfig
    from veilspark.operators import token_rows
    from veilspark.plans import token_queries

    assert token_queries._documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    texts = spark.createDataFrame([(1, "Card   4111 1111  1111 1111\nmail a@b.example"), (2, "road\ncity")], "id int, text string")
    cfg = ScanConfig.of(["card", "email", "address"])
    assert sorted(r["type"] for r in token_rows.token_detections(texts, ["id"], cfg).where(F.col("id") == 1).collect()) == ["CREDIT_CARD", "EMAIL"]
    assert token_rows.line_gate(ScanConfig.of(["password"])) is None and token_rows.line_gate(cfg) is not None
