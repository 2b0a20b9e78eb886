"""Reading images: without a reader, without images, readers that fail, and columns whose names clash."""

from pyspark.sql import functions as F

from veilspark.config import ScanConfig
from veilspark.operators.scan import responses
from veilspark.sources.tables import read_images

SCHEMA = "id int, height int, width int, data binary, ocr string, extra string"


def reader():
    """A reader that is sent to tasks whole, as they cannot import this file."""

    def word(image, scale):
        if image[0, 0, 0] == 9:
            raise RuntimeError("broken")
        return [{"text": "a@b.example", "conf": 80, "left": scale, "top": 0.0, "width": 2 * scale, "height": scale}]

    return word


def rows(spark):
    data = [(1, 2, 4, bytes(24), "old", "x"), (2, 2, 4, bytes(23), "old", "y"), (3, 2, 4, None, None, None), (4, 2, 4, b"\x09" * 24, None, "z"), (5, None, None, bytes(24), None, None)]
    return spark.createDataFrame(data, SCHEMA)


def test_statuses_and_tokens(spark):
    got = {r.id: (r.ocr_status, r.ocr and [tuple(t) for t in r.ocr], r.extra) for r in read_images(rows(spark), reader()).collect()}
    assert got == {1: ("read", [("a@b.example", 1.0, 0.0, 2.0, 1.0)], "x"), 2: (None, None, "y"), 3: (None, None, None), 4: ("failed", [], "z"), 5: (None, None, None)}


def test_without_a_reader(spark):
    got = {r.id: (r.ocr_status, r.ocr) for r in read_images(rows(spark), None).collect()}
    assert got == {1: ("unavailable", []), 2: (None, None), 3: (None, None), 4: ("unavailable", []), 5: (None, None)}


def test_empty_table(spark):
    assert read_images(rows(spark).limit(0), reader()).collect() == []


def test_answers(spark):
    asked = read_images(rows(spark), reader()).withColumns({"tokens": F.expr("CAST(null AS array<struct<text:string,bbox:array<double>>>)"), "text": F.lit("SSN 123-45-6789")})
    done = responses(asked, ["id", "ocr_status"], ScanConfig.of(["email", "ssn"]))
    got = {r.id: (r.ocr_status, [d.type for d in r.detections]) for r in done.collect()}
    assert got == {1: ("read", ["EMAIL"]), 2: (None, ["SSN"]), 3: (None, ["SSN"]), 4: ("failed", []), 5: (None, ["SSN"])}
