import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspark.config import ScanConfig
from veilspark.functions import geometry
from veilspark.operators import images, scan, spatial
from veilspark.sources.tables import two_pass_tokens


def tokens(*rows):
    return [dict(zip(("text", "x", "y", "w", "h"), (t, *map(float, b)), strict=True)) for t, *b in rows]


def test_located(spark):
    rows = [
        (1, tokens(("4111", 10, 50, 45, 20), ("1111", 60, 50, 45, 20), ("1111", 110, 50, 45, 20), ("1111", 160, 50, 45, 20)), 500.0, 300.0),
        (2, tokens(("41111111", 10, 50, 90, 20), ("11111111", 10, 80, 90, 20)), None, None),
        (3, tokens(("12345678", 10, 50, 90, 20), ("90123456", 10, 80, 90, 20)), None, None),
        (4, tokens(("Address:", 10, 10, 80, 20), ("12,", 10, 40, 30, 20), ("Anna", 45, 40, 40, 20), ("Nagar", 90, 40, 50, 20), ("Road,", 190, 40, 50, 20), ("Chennai", 10, 70, 80, 20), ("600040", 210, 70, 60, 20)), None, None),
        (5, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, tokens array<{spatial.TOKEN}>, iw double, ih double")
    found = {(r.id, r.type, r.confidence): r.bbox for r in spatial.token_detections(df, ["id"], None, "tokens", "iw", "ih").collect()}
    assert found == {(1, "CREDIT_CARD", 0.6): [7.6, 47.6, 199.8, 24.8], (2, "CREDIT_CARD", 0.6): [4.0, 44.0, 102.0, 62.0], (4, "ADDRESS", 0.99): [0.4, 0.4, 279.2, 99.2]}


def test_lines_and_boxes(spark):
    df = spark.createDataFrame([(tokens(("A", 0, 100, 20, 20), ("B", 30, 102, 20, 20), ("C", 0, 200, 20, 20)),)], f"t array<{spatial.TOKEN}>")
    lines = df.select(spatial.group_lines(F.col("t")).alias("l")).first().l
    assert [[t.text for t in line] for line in lines] == [["A", "B"], ["C"]]
    a, b = (geometry.box(*map(F.lit, v)) for v in ((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 10.0, 10.0)))
    r = spark.range(1).select(geometry.iou(a, b).alias("iou"), geometry.union_box(F.array(a, b)).alias("u"), geometry.pad_box(geometry.box(*map(F.lit, (0.0, 0.0, 100.0, 20.0))), 0.5, F.lit(200.0), F.lit(200.0)).alias("p")).first()
    assert abs(r.iou - 1 / 3) < 1e-9 and tuple(r.u) == (0, 0, 15, 10) and tuple(r.p) == (0, 0, 120, 40)


def test_two_ocr_passes(spark):
    raw = "array<struct<text:string,conf:string,left:double,top:double,width:double,height:double>>"
    first = [("Card", "90", 0.0, 0.0, 40.0, 20.0), ("noise", "10", 50.0, 0.0, 40.0, 20.0), (" ", "99", 0.0, 0.0, 1.0, 1.0)]
    second = [("Card", "90", 0.0, 0.0, 80.0, 40.0), ("sk-test-9fJ2Kd8s", "5", 400.0, 0.0, 80.0, 40.0), ("low", "25", 600.0, 0.0, 80.0, 40.0)]
    df = spark.createDataFrame([(first, second)], f"a {raw}, b {raw}")
    got = df.select(two_pass_tokens(F.col("a"), F.col("b")).alias("t")).first().t
    assert [(t.text, t.x) for t in got] == [("Card", 0.0), ("sk-test-9fJ2Kd8s", 200.0), ("low", 300.0)]


def test_images(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    for mode in ("blur", "pixelate", "redact", "frosted"):
        for severity in ("low", "critical"):
            copy = image.copy()
            attempts, safe = images.protect_and_verify(copy, (5, 5, 30, 20), severity, mode)
            assert safe and attempts == 1 and (copy[:5] == image[:5]).all() and not (copy[5:25, 5:35] == image[5:25, 5:35]).all()
    assert images.protect_and_verify(image.copy(), (5, 5, 30, 20), "low", "blur", lambda _: True) == (3, False)
    df = spark.createDataFrame([(1, 40, 60, bytearray(image.tobytes()), [(5.0, 5.0, 30.0, 20.0, "high")])], "image_id long, height int, width int, data binary, boxes array<struct<x:double,y:double,w:double,h:double,severity:string>>")
    assert images.protect_images(df).first().verified == [True]


def test_png(spark):
    image = np.random.default_rng(3).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, 5, 7, bytearray(image.tobytes())), (2, None, None, None)], "id int, h int, w int, data binary")
    first, none = df.select("id", images.png_of("data", "h", "w").alias("p")).orderBy("id").collect()
    assert none.p is None and first.p[:8] == b"\x89PNG\r\n\x1a\n"
    raw = np.frombuffer(zlib.decompress(bytes(first.p)[41 : 41 + int.from_bytes(first.p[33:37])]), np.uint8).reshape(5, 22)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:].reshape(5, 7, 3) == image).all()


REQUEST = f"id int, tokens array<struct<text:string,bbox:array<double>>>, ocr array<{spatial.TOKEN}>, text string, height int, width int, data binary"


def test_responses(spark):
    noise = np.random.default_rng(1).integers(0, 255, (120, 300, 3)).astype(np.uint8)
    image = bytearray(noise.tobytes())
    mail, ssn = tokens(("a@b.example", 10, 10, 120, 20)), tokens(("SSN", 10, 60, 30, 20), ("123-45-6789", 50, 60, 120, 20))
    rows = [
        (1, None, mail + ssn, "c@d.example", 120, 300, image),
        (2, [("a@b.example", [10.0, 10.0, 120.0, 20.0])], None, None, None, None, None),
        (3, None, mail, "c@d.example and e@f.example", 120, 300, image[:-1]),
        (4, None, [], "c@d.example", 120, 300, image),
        (5, None, None, None, None, None, None),
        (6, None, None, "c@d.example", 120, 300, image),
    ]
    df = spark.createDataFrame(rows, REQUEST).union(spark.sql("SELECT 7, null, null, CAST(x'ff6140622e6578616d706c65' AS string), 1, 1, null"))
    cfg = ScanConfig.of(["email", "ssn"], mode="pixelate")

    def stubborn(pixels):
        """Reads an address until a region of six blocks has become one of three, and never a number."""
        return "still a@b.example" if len(np.unique(pixels.reshape(-1, 3), axis=0)) > 4 else "123-45"

    for read, attempts in ((None, {"EMAIL": 1, "SSN": 1}), (stubborn, {"EMAIL": 2, "SSN": 1})):
        got = {r.id: r for r in scan.responses(df, ["id"], cfg, read).collect()}
        assert {i: (r.total_detections, r.status) for i, r in got.items()} == {1: (2, "completed"), 2: (1, "completed"), 3: (2, "completed"), 4: (0, "completed"), 5: (0, "completed"), 6: (0, "completed"), 7: (0, "failed")}
        assert {d.type: d.attempts for d in got[1].detections} == attempts and all(d.verification_passed for r in got.values() for d in r.detections)
        assert got[7].privacy_score == 50.0 and got[5].privacy_score == 100.0 and got[1].critical_count == 1
        assert bytes(got[4].data) == bytes(image) and got[3].data is None
        after = np.frombuffer(got[1].data, np.uint8).reshape(noise.shape)
        box = {d.type: d.bbox for d in got[1].detections}["EMAIL"]
        changed = np.argwhere((after != noise).any(axis=2)[:50])
        assert changed.min(axis=0).tolist() == [int(box[1]), int(box[0])] and (after[100:] == noise[100:]).all()
    always = scan.responses(df.where("id = 1"), ["id"], cfg, lambda _: "a@b.example").first()
    assert {d.type: (d.attempts, d.verification_passed) for d in always.detections} == {"EMAIL": (3, False), "SSN": (1, True)}
    broken = scan.responses(df.where("id = 1"), ["id"], cfg, lambda _: 1 / 0).first()
    assert all(d.verification_passed for d in broken.detections)
