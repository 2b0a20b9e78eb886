import duckdb
import pytest

import __spark_entry__
from veilspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "type", "text", "confidence", "severity", "bbox", "status", "verification_passed", "attempts"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.config import ScanConfig
    from veilspark.operators.scan import detections
    from veilspark.streaming.scan import scan_stream

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    cfg = ScanConfig.of(["EMAIL", "CREDIT_CARD", "IP_ADDRESS"])
    scan_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), ["doc_id"], cfg).awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, detections(docs, ["doc_id"], cfg).collect()))


def test_observed_counts(spark):
    from pyspark.sql import Observation

    from veilspark.config import ScanConfig
    from veilspark.operators.client import observed
    from veilspark.operators.scan import detections

    texts = spark.createDataFrame([(1, "mail a@b.example"), (2, "SSN 123-45-6789 and c@d.example"), (3, None)], "id int, text string")
    metrics = Observation("scan")
    assert observed(detections(texts, ["id"], ScanConfig.of(["email", "ssn"])), metrics).count() == 3
    assert metrics.get == {"total": 3, "critical": 1, "protected": 3}
