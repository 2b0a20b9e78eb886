"""What a client shows of detections: its own names, severities and boxes relative to the image."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The client's types, their labels and severities (an API key counts less here than in a scan), and those that are on at first.
CLIENT_TYPES = {
    "AADHAAR": ("Aadhaar", "critical"),
    "CREDIT_CARD": ("Credit Card", "critical"),
    "DEBIT_CARD": ("Debit Card", "critical"),
    "API_KEY": ("API Key", "high"),
    "PASSWORD": ("Password", "high"),
    "EMAIL": ("Email", "medium"),
    "PHONE": ("Phone Number", "medium"),
    "IP_ADDRESS": ("IP Address", "low"),
    "JWT_TOKEN": ("JWT Token", "high"),
    "ACCESS_TOKEN": ("Access Token", "high"),
    "EMPLOYEE_ID": ("Employee ID", "low"),
    "ADDRESS": ("Address", "medium"),
    "CUSTOM": ("Custom Pattern", "medium"),
}
ENABLED = ("AADHAAR", "CREDIT_CARD", "DEBIT_CARD", "API_KEY", "ACCESS_TOKEN", "JWT_TOKEN", "PASSWORD", "EMAIL", "PHONE", "ADDRESS")


def client_types(spark: SparkSession) -> DataFrame:
    """The table of the client's types: type, label, severity, enabled."""
    rows = [(kind, label, severity, kind in ENABLED) for kind, (label, severity) in CLIENT_TYPES.items()]
    return spark.createDataFrame(rows, "type string, label string, severity string, enabled boolean")


def client_type(kind: Column) -> Column:
    """The client's type; what it has no name for is CUSTOM."""
    return F.when(kind.isin(*CLIENT_TYPES), kind).otherwise(F.lit("CUSTOM"))


def client_detections(found: DataFrame, keys: list[str], width: Column, height: Column, enabled: Iterable[str] = ENABLED) -> DataFrame:
    """Detections as the client lists them; those of types that are not enabled go.

    found: rows of ``scan.detections``; width, height: of the image, where null or nothing count as 1. Boxes become parts of the image, a
    box without extent starts at 0; confidence becomes percent with one decimal, halves up. A null box gives nulls.
    """
    size = lambda n: F.when(n > 0, n.cast("double")).otherwise(F.lit(1.0))
    start = lambda at, extent, whole: F.when(extent.isNull(), None).when(extent > 0, at / whole).otherwise(F.lit(0.0))
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    kind = client_type(F.col("type"))
    severity = F.coalesce(*[F.when(kind == k, s) for k, (_, s) in CLIENT_TYPES.items()])
    return found.select(
        *keys,
        kind.alias("type"),
        F.col("text").alias("masked"),
        (F.floor(F.col("confidence") * 1000 + 0.5) / 10).alias("confidence"),
        severity.alias("severity"),
        (F.col("status") == "protected").alias("protected"),
        start(x, w, size(width)).alias("x"),
        start(y, h, size(height)).alias("y"),
        (w / size(width)).alias("width"),
        (h / size(height)).alias("height"),
    ).where(F.col("type").isin(*enabled))


def observed(found: DataFrame, metrics: Observation) -> DataFrame:
    """Detections that report counts while they are written, and nothing of what was found: total, critical and protected ones."""
    return found.observe(
        metrics,
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("status") == "protected").alias("protected"),
    )
