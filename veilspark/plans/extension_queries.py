"""Queries of the extensions: streams with state, as-of joins, sketches under a cube, the riskiest documents; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators import relational, scan
from ..operators.catalog import RISK
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import state
from ..streaming.scan import windowed_counts

_KINDS = ["email", "ip_address", "swift_bic", "card"]
#: A sketch of 2 ** 14 registers is within four standard errors nearly always.
_WITHIN = 4 * 1.04 / 128
#: What an event says, an expression of both dialects.
_SAID = "CASE event_id % 5 WHEN 0 THEN concat('mail u', CAST(user_id AS STRING), '@shop.example') WHEN 1 THEN 'host 10.0.0.1 is up' WHEN 2 THEN concat('SSN 123-45-', lpad(CAST(event_id % 10000 AS STRING), 4, '0')) ELSE 'nothing to see' END"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by type in windows of 6 hours that slide by 2, as they stand when all have come."""
    events = table(spark, sf_dir, "events")
    timed = state.arriving(spark, f"{sf_dir.rstrip('/')}/events.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed_counts(timed, "6 hours", "2 hours")
    found = state.run_to_end(counted, shared_folder(spark, "stream"), "complete")
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n")


def stream_user_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in what events say, on a stream, summed by user in its state: the last that is known of each user."""
    events = state.arriving(spark, f"{sf_dir.rstrip('/')}/events.parquet", table(spark, sf_dir, "events").schema)
    found = scan.detections(events.select("user_id", "event_id", F.expr(_SAID).alias("text")), ["user_id", "event_id"], ScanConfig.of(["email", "ip_address", "ssn"]))
    risk = state.user_risk(found.select("user_id", scan.severity_weight(F.col("severity")).cast("long").alias("weight")), "user_id", "weight")
    given = state.run_to_end(risk, shared_folder(spark, "stream"), "update")
    return given.groupBy("user_id").agg(F.max_by(F.struct("n", "weight"), "seen").alias("last")).select("user_id", "last.n", "last.weight")


def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the user's last view before it, if it was less than two days earlier."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = relational.asof_join(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", tie="event_id", tolerance="2 days")
    return found.select("event_id", "user_id", F.col("match.event_id").alias("view_id"), F.col("match.value").alias("view_value"))


def detection_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and documents with any, under every grouping of source, language and type; documents exactly, and from merged sketches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = scan.detections(docs, ["doc_id", "source", "lang"], ScanConfig.of(_KINDS)).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "type")
    by = ["source", "lang", "type"]
    each = found.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("each"))  # both sides read this shuffle, so documents are scanned once
    about = relational.cube_of_sketches(relational.distinct_sketches(each, by, "doc_id", F.col("each")), by)
    exact = each.cube(*by).agg(F.countDistinct("doc_id").alias("documents"), *[F.grouping(c).alias(f"_{c}") for c in by])
    exact = exact.select(*[F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c)).alias(c) for c in by], "documents")
    near = F.abs(F.col("about") - F.col("documents")) <= F.greatest(F.lit(1.0), F.col("documents") * F.lit(_WITHIN))
    return about.join(exact, by).select(*by, "n", "documents", near.alias("sketch_holds"))


def riskiest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents of each source and language that score least, of equal ones those with most detections, then the least ids."""
    docs = table(spark, sf_dir, "documents")
    scored = scan.summaries(docs.select("doc_id", "source", "lang", "text"), ["doc_id", "source", "lang"], ScanConfig.of(_KINDS))
    best = relational.top_k(scored, ["source", "lang"], [F.col("privacy_score").asc(), F.col("total_detections").desc(), F.col("doc_id").asc()], 3)
    return best.select("source", "lang", "rank", "doc_id", "privacy_score", "total_detections")


QUERIES = {f.__name__: f for f in (stream_windows, stream_user_risk, views_before_purchases, detection_cube, riskiest_documents)}


def oracles(found: str, summaries: str) -> dict[str, str]:
    """found: CTEs of all detections of documents with source and lang, of the kinds above; summaries: their summaries by doc_id, source, lang."""
    label = lambda c: f"CASE WHEN grouping({c}) = 1 THEN '*' ELSE {c} END AS {c}"
    return {
        "stream_windows": """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n
            FROM (SELECT event_type, unnest([time_bucket(INTERVAL '2 hours', ts) - i * INTERVAL '2 hours' FOR i IN [0, 1, 2]]) AS s FROM events) GROUP BY ALL""",
        "stream_user_risk": f"SELECT user_id, count(*) AS n, CAST(sum(CASE event_id % 5 WHEN 0 THEN {RISK['medium']} WHEN 1 THEN {RISK['low']} ELSE {RISK['critical']} END) AS BIGINT) AS weight FROM events WHERE event_id % 5 < 3 GROUP BY user_id",
        "views_before_purchases": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
            SELECT p.event_id, p.user_id, CASE WHEN v.ts >= p.ts - INTERVAL '2 days' THEN view_id END AS view_id, CASE WHEN v.ts >= p.ts - INTERVAL '2 days' THEN view_value END AS view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
        "detection_cube": f"""{found}, f AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, type FROM found)
            SELECT {label('source')}, {label('lang')}, {label('type')}, count(*) AS n, count(DISTINCT doc_id) AS documents, true AS sketch_holds FROM f GROUP BY CUBE (source, lang, type)""",
        "riskiest_documents": f"""SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY privacy_score, total_detections DESC, doc_id) AS rank, doc_id, privacy_score, total_detections
            FROM ({summaries}) QUALIFY rank <= 3""",
    }
