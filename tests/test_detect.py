import pytest
from pyspark.sql import functions as F

from veilspark.config import ScanConfig, accepted_patterns, for_java, judged_patterns, normalize_type
from veilspark.operators import scan
from veilspark.operators.detect import candidates, detect, resolve

CASES = [
    ("Aadhaar Number: 4829 1736 4926", None, [("AADHAAR", 0.99)]),
    ("4829 1736 4926", None, [("AADHAAR", 0.6)]),
    ("Aadhaar Number: 2345 6789 0123", None, [("AADHAAR", 0.48)]),
    ("2345 6789 0123", None, []),
    ("Credit Card: 5555 5555 5555 4444", None, [("CREDIT_CARD", 0.99)]),
    ("4111111111111111", None, [("CREDIT_CARD", 0.6)]),
    ("email a@b.com card 4111 1111 1111 1111", None, [("EMAIL", 0.98), ("CREDIT_CARD", 0.85)]),
    ("email a@b.com card 4111 1111 1111 1111", ["EMAIL"], [("EMAIL", 0.98)]),
    ("Card: 5264 1234 5678 9012", None, []),
    ("Order Number: 123456789012", None, []),
    ("Product ID: 111122223333", None, []),
    ("CVV: 482", None, [("CVV", 0.6)]),
    ("Room 482 on floor 9", None, []),
    ("Meeting on 09/29 at noon", None, []),
    ("Exp date 09/29", None, [("CARD_EXPIRY", 0.6)]),
    ("PAN: ABCDE1234F", None, [("PAN", 0.92)]),
    ("Phone Number: +91 98765 43210", None, [("PHONE", 0.85)]),
    ("Phone: +1 555 123 4567", None, [("PHONE", 0.45)]),
    ("Contact support: +1 555 123 4567", None, []),
    ("Password: MySecret123", None, [("PASSWORD", 0.9)]),
    ("I forgot my password yesterday.", None, []),
    ("server 192.168.1.10", None, [("IP_ADDRESS", 0.9)]),
    ("server 999.1.1.1 or 192.168.01.1", ["IP_ADDRESS"], []),
    ("Address:\n12, Anna Nagar Main Road,\nChennai, Tamil Nadu - 600040", ["ADDRESS"], [("ADDRESS", 0.99)]),
    ("We drove down the road into the city.", ["ADDRESS"], []),
    ("Please provide your address", ["ADDRESS"], []),
    ("Home Address: 12 Example Road, Chennai - 600040. Phone +91 9876543210 email a@b.com", ["ADDRESS", "PHONE", "EMAIL"], [("ADDRESS", 0.56), ("PHONE", 0.45), ("EMAIL", 0.98)]),
    ("7730 0889 2163 4926", ["aadhaar"], []),
    ("nothing sensitive here", None, []),
    ("", None, []),
    (None, None, []),
]


def test_goldens(spark):
    by_types = {}
    for i, (text, enabled, _) in enumerate(CASES):
        by_types.setdefault(tuple(enabled or ()), []).append((i, text))
    for enabled, rows in by_types.items():
        df = spark.createDataFrame(rows, "id int, text string")
        for r in scan.with_matches(df, ScanConfig.of(enabled)).collect():
            assert [(m.type, m.confidence) for m in r.matches] == CASES[r.id][2], CASES[r.id][0]
            assert all(r.text[m.start : m.end].strip() == m.value or m.type == "ADDRESS" for m in r.matches)


def test_threshold_before_or_after_resolution(spark):
    df = spark.createDataFrame([(i, t) for i, (t, e, _) in enumerate(CASES) if e is None], "id int, text string")
    text = F.coalesce("text", F.lit(""))
    rows = df.select(detect(text, ScanConfig()).alias("a"), F.filter(detect(text, ScanConfig(), kept_only=False), lambda m: m["confidence"] >= 0.45).alias("b")).collect()
    assert all([(m.type, m.start) for m in r.a] == [(m.type, m.start) for m in r.b] for r in rows)


def test_signals_never_hold_the_value(spark):
    df = spark.createDataFrame([("Card Number: 4111 1111 1111 1111 password=hunter22 +91 98765 43210",)], "text string")
    for m in scan.with_matches(df, explain=True).first().matches:
        assert m.signals and all(m.value not in s for s in m.signals)


def test_custom_patterns(spark):
    specs = [{"name": "Employee ID", "regex": "EMP-[0-9]{6}"}, {"name": "a", "regex": "(a+)+$"}, {"name": "b", "regex": "([unclosed"}, {"name": ""}, {"name": "long", "regex": "x" * 301}, {"name": "C.1", "confidence": 70}]
    accepted = accepted_patterns(specs)
    assert [(p.name, p.regex, p.confidence) for p in accepted] == [("Employee ID", "EMP-[0-9]{6}", 0.85), ("C.1", r"C\.1", 0.7)]
    rows = scan.detections(spark.createDataFrame([(1, "Staff EMP-123456 active C.1 Cx1")], "id int, text string"), ["id"], ScanConfig.of(["custom"], specs)).collect()
    assert [(r.type, r.text, r.confidence) for r in rows] == [("CUSTOM_PATTERN", "•" * 10, 0.85), ("CUSTOM_PATTERN", "••••", 0.7)]


def test_custom_patterns_see_whole_texts(spark):
    df = spark.createDataFrame([(1, "EMP-111111 " + "word " * 4000 + "EMP-222222 " + "word " * 20000 + "EMP-333333")], "id int, text string")
    specs = [{"name": "Employee ID", "regex": "EMP-[0-9]{6}"}]
    for budget, want in ((None, ["EMP-111111", "EMP-222222", "EMP-333333"]), (20_000, ["EMP-111111"])):
        found = scan.with_matches(df, ScanConfig.of(["custom"], specs, custom_text=budget)).first().matches
        assert [m.value for m in found] == want and all(df.first().text[m.start : m.end] == m.value for m in found)


@pytest.mark.parametrize(("name", "kind"), [("Credit  Card", "CREDIT_CARD"), (" uid ", "AADHAAR"), ("api-key", "API_KEY"), ("Custom Pattern", "CUSTOM_PATTERN"), ("swift_bic", "SWIFT_BIC")])
def test_type_names(name, kind):
    assert normalize_type(name) == kind


def test_an_empty_choice_means_all():
    assert ScanConfig.of([]).enabled is None and ScanConfig.of(["card"]).enabled == {"CREDIT_CARD", "DEBIT_CARD"}


def test_summaries_and_redaction(spark):
    df = spark.createDataFrame([(1, "email a@b.com card 4111 1111 1111 1111"), (2, None)], "id int, text string")
    rows = {r.id: r for r in scan.summaries(df, ["id"]).collect()}
    assert (rows[1].total_detections, rows[1].critical_count, rows[1].privacy_score, rows[1].client_score) == (2, 1, 98.3, 98)
    assert (rows[2].total_detections, rows[2].privacy_score, rows[2].client_score) == (0, 100.0, 100)
    clean = df.where("id = 1").select(scan.redact_text(F.col("text"), ScanConfig.of(["EMAIL", "CREDIT_CARD"])).alias("t")).first().t
    assert clean == "email a•••@b••.••• card XXXX XXXX XXXX 1111"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (r"(?P<y>EMP)-\d+(?P=y)", r"(EMP)-\d+(?:\1)"), ("(?:a|b)*c?", None), ("(a+)+$", None), ("((ab)?c){2,}", None), ("(?:a|b){3}", "(?:a|b){3}"), ("(?:ab)+c*", "(?:ab)+c*"),
        ("(?:a|b){1,500}", None), (r"[)(|*\]]+x", r"[)(|*\]]+x"), (r"[[&]a\Z", r"[\[\&]a\z"), (r"\((x|y)\)*", r"\((x|y)\)*"), ("(?i)ab(?=c)", "(?i)ab(?=c)"),
    ],
)
def test_patterns_for_java(source, want):
    assert for_java(source) == want


def test_bad_patterns_are_named(spark):
    specs = [{"name": "loop", "regex": "(?:a|b)*"}, {"name": "open", "regex": "([x"}, {"name": "", "regex": "x"}, {"name": "ok", "regex": "x|y"}, {"name": "cond", "regex": "(a)?(?(1)b|c)"}]
    good, bad = judged_patterns(specs)
    assert [p.name for p in good] == ["ok"] and dict(bad) == {"loop": "a repeated group has choices", "open": "not a pattern", "": "no name", "cond": "not a pattern"}


def test_many_matches_keep_their_places(spark):
    """Offsets run over blocks of matches, and redaction over all of them."""
    text = " ".join(f"u{i}@x.io, é😀" for i in range(500))
    row = spark.createDataFrame([(text,)], "text string").select(detect(F.col("text"), ScanConfig.of(["email"])).alias("m"), scan.redact_text(F.col("text"), ScanConfig.of(["email"])).alias("r")).first()
    assert [m.value for m in row.m] == [f"u{i}@x.io" for i in range(500)] and all(m.value == text[m.start : m.end] for m in row.m)
    assert row.r == " ".join("u•••@x••.•••, é😀" for _ in range(500))


def test_overlaps_against_plain_greedy(spark):
    """Runs of overlapping candidates are resolved as one greedy pass over all of them would."""
    text = " ".join(f"ABCD0{i:06d} 4111 1111 1111 1111 x{i}@okaxis.io +91 98765 4{i:04d} 1.1.1.{i % 250}" for i in range(60))
    cfg = ScanConfig()
    row = spark.createDataFrame([(text,)], "text string").select(candidates(F.col("text"), cfg).alias("c"), resolve(candidates(F.col("text"), cfg)).alias("m")).first()
    kept = []
    for x in sorted(row.c, key=lambda x: (x.neg, x.shorter, x.ord, x.start)):
        if not any(k.start < x.end and x.start < k.end and (k.type == x.type or "ADDRESS" not in (k.type, x.type)) for k in kept):
            kept.append(x)
    assert len(kept) > 200 and [(m.start, m.type) for m in row.m] == sorted((m.start, m.type) for m in kept)
