"""As-of joins, best rows of groups and sketches against plain versions; streams against tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import relational
from veilspark.streaming import state
from veilspark.streaming.scan import sessions, windowed_counts

START = dt.datetime(2024, 1, 1)


def moment(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("tolerance", [None, "90 minutes"])
@pytest.mark.parametrize("span", ["1 hour", "30 days"])
def test_asof_against_all_rows(spark, tolerance, span):
    rng = random.Random(6)
    row = lambda i: (i, rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.05 else moment(rng.randint(0, 3000)))
    left, right = [row(i) for i in range(300)], [row(i) for i in range(200)]
    left += left[:3]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, k string, ts timestamp")
    got = relational.asof_join(frame(left, "a"), frame(right, "b"), "k", tie="b", tolerance=tolerance, span=span).select("a", "match.b").collect()
    want = []
    for a, k, t in left:
        before = [(u, b) for b, m, u in right if k is not None and t is not None and k == m and u is not None and u <= t]
        u, b = max(before, default=(None, None))
        want.append((a, None if b is None or (tolerance and u < t - dt.timedelta(minutes=90)) else b))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = frame([], "b")
    assert relational.asof_join(frame(left, "a"), empty, "k", tie="b").where("match IS NOT NULL").count() == 0


def test_top_k_keeps_few_before_the_shuffle(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.randint(0, 20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, s int, i int").repartition(7)
    best = relational.top_k(df, ["g"], [F.col("s").asc(), F.col("i").asc()], 4)
    assert best._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    want = [(g, s, i, n + 1) for g in ("hot", "x", None) for n, (s, i) in enumerate(sorted((s, i) for h, s, i in rows if h == g)[:4])]
    assert sorted(map(tuple, best.collect()), key=str) == sorted(want, key=str)


def test_sketches_of_days_merge(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 9), rng.choice("ab"), rng.randint(0, 30_000)) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "day int, kind string, v int")
    daily = relational.distinct_sketches(df, ["day", "kind"], "v")
    assert daily.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    got = {(r["day"], r["kind"]): (r["n"], r["about"]) for r in relational.cube_of_sketches(daily, ["day", "kind"]).collect()}
    for day in [*range(1, 10), "*"]:
        for kind in "ab*":
            own = [v for d, k, v in rows if day in (d, "*") and kind in (k, "*")]
            n, about = got[str(day), kind]
            assert n == len(own) and abs(about - len(set(own))) <= 4 * 1.04 / 128 * len(set(own))


@pytest.fixture(scope="module")
def events():
    rng = random.Random(12)
    return [(i, moment(rng.randint(0, 600)), rng.randint(0, 6), rng.choice("ab")) for i in range(400)]


def _files(spark, rows, folder, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], "event_id int, ts timestamp, user_id int, event_type string").coalesce(1).write.mode("append").parquet(folder)


def test_streams_equal_tables_whatever_the_order(spark, events, tmp_path):
    schema = "event_id int, ts timestamp, user_id int, event_type string"
    shuffled = random.Random(1).sample(events, len(events))
    _files(spark, shuffled, str(tmp_path / "in"), 5)
    stream = lambda: state.arriving(spark, str(tmp_path / "in"), schema, files=1)
    batch = spark.createDataFrame(events, schema)
    found = state.run_to_end(windowed_counts(stream(), "1 hour", "20 minutes", late="1 day"), str(tmp_path / "w"), "complete")
    assert found.agg(F.max("_batch")).first()[0] == 4
    flat = lambda df: sorted(map(str, df.drop("_batch").collect()))
    assert flat(found) == flat(windowed_counts(batch, "1 hour", "20 minutes"))
    found = state.run_to_end(sessions(stream(), "7 minutes", late="1 day"), str(tmp_path / "s"), "complete")
    assert flat(found) == flat(sessions(batch, "7 minutes"))
    risk = state.run_to_end(state.user_risk(stream().withColumn("w", F.lit(3)), "user_id", "w"), str(tmp_path / "r"), "update")
    last = risk.groupBy("user_id").agg(F.max_by(F.struct("n", "weight"), "seen").alias("l")).select("user_id", "l.*")
    assert flat(last) == flat(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(3)).cast("long").alias("weight")))


def test_late_rows_and_repeats(spark, tmp_path):
    schema = "event_id int, ts timestamp, user_id int, event_type string"
    parts = [[(1, moment(0), 1, "a"), (2, moment(4), 1, "a")], [(3, moment(100), 1, "a"), (2, moment(5), 1, "a")], [(4, moment(1), 1, "a"), (5, moment(98), 1, "a")], [(6, moment(300), 1, "a")]]
    for i, rows in enumerate(parts):
        one = spark.createDataFrame(rows, schema).coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in"))
        state.run_to_end(windowed_counts(state.arriving(spark, str(tmp_path / "in"), schema), "10 minutes", late="10 minutes"), str(tmp_path / "w"), "append")
        state.run_to_end(state.distinct_within(state.arriving(spark, str(tmp_path / "in"), schema), ["event_id"], late="10 minutes"), str(tmp_path / "d"), "append")
    windows = spark.read.parquet(str(tmp_path / "w/out")).select(F.date_format("window.start", "HH:mm").alias("s"), "n")
    # the row of minute 1 comes after minute 100 was seen, so its window is closed and it is left out; that of minute 98 is in time
    assert sorted(map(tuple, windows.collect())) == [("00:00", 3), ("01:30", 1), ("01:40", 1)]
    once = spark.read.parquet(str(tmp_path / "d/out")).select("event_id")
    assert sorted(r[0] for r in once.collect()) == [1, 2, 3, 5, 6]


def test_a_stream_goes_on_after_a_restart(spark, events, tmp_path):
    schema = "event_id int, ts timestamp, user_id int, event_type string"
    run = lambda: state.run_to_end(state.user_risk(state.arriving(spark, str(tmp_path / "in"), schema).withColumn("w", F.lit(2)), "user_id", "w"), str(tmp_path / "r"), "update")
    _files(spark, events[:150], str(tmp_path / "in"), 2)
    assert run().groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 150
    _files(spark, events[150:], str(tmp_path / "in"), 2)
    got = run().groupBy("user_id").agg(F.max_by("weight", "seen").alias("w")).collect()
    assert {r["user_id"]: r["w"] for r in got} == {u: 2 * sum(e[2] == u for e in events) for u in range(7)}
    assert run().count() == run().count()  # nothing new: nothing is given out again
