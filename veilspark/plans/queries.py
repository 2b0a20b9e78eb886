"""Registered queries over the test tables, each with the SQL that gives the same rows where SQL can say it.

The tables hold few identifiers, so several queries scan messages that are composed from keys in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALIASES, ScanConfig, normalize_type_column
from ..functions import geometry, masks, validators
from ..functions.text import between, has_any, plain, spans
from ..operators import client, images, scan, scoring, spatial
from ..operators.catalog import BY_KIND, PATTERNS, RISK
from ..operators.detect import detect
from ..sources.tables import dealt, merge_tokens, ocr_tokens, spread, table
from ..streaming.scan import sessions, windowed_counts
from . import detection_sql as full
from . import extension_queries, image_queries, token_queries

_LETTERS = r"regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def _digits(key: str, factor: int, n: int) -> str:
    """n digits from a key, as an expression of both dialects."""
    return f"lpad(CAST(({key} * {factor}) % {10**n} AS STRING), {n}, '0')"


_N12, _N16 = _digits("c_custkey", 7919000013, 12), _digits("c_custkey", 636413622384, 16)


def _sql_luhn(s: str) -> str:
    x = f"CAST(substr({s}, length({s}) - i, 1) AS INT)"
    return f"list_sum(list_transform(range(0, length({s})), lambda i: CASE WHEN i % 2 = 0 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)) % 10 = 0"


def _sql_verhoeff(s: str) -> str:
    group = "".join(map(str, validators.GROUP))
    perm = "".join(map(str, validators.PERMUTATION["compat"]))
    digit = f"CAST(substr({s}, 12 - i, 1) AS INT)"
    moved = f"list_transform(range(0, 12), lambda i: CAST(substr('{perm}', CAST((i % 8) * 10 + {digit} + 1 AS BIGINT), 1) AS INT))"
    return f"list_reduce(list_prepend(0, {moved}), lambda c, e: CAST(substr('{group}', CAST(c * 10 + e + 1 AS BIGINT), 1) AS INT)) = 0"


def _found(df: DataFrame, keys: list[str], text: Column, kinds: list[str], custom: list[dict] | None = None) -> DataFrame:
    return spread(df).select(*keys, F.explode(detect(text, ScanConfig.of(kinds, custom or ()))).alias("m")).select(*keys, "m.*")


def _candidates(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return df.select(*keys, F.explode(spans(F.coalesce("text", F.lit("")), f"(?U){BY_KIND[kind].regex}")).alias("m")).select(*keys, "m.*")


def _flat(found: DataFrame) -> DataFrame:
    """Detections with the four numbers of their box as columns."""
    return found.select(*[c for c in found.columns if c != "bbox"], *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan.detections(table(spark, sf_dir, "documents"), ["doc_id"]))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan.detections(table(spark, sf_dir, "pages"), ["page_id"], text="html"))


def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scan.detections(table(spark, sf_dir, "conversations"), ["conv_id", "turn"]))


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summaries(table(spark, sf_dir, "documents"), ["doc_id"])


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report_by_type(scan.detections(table(spark, sf_dir, "documents"), ["doc_id"]))


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report_totals(scan.detections(table(spark, sf_dir, "conversations"), ["conv_id"]))


def redacted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scan.redact_text(F.coalesce("text", F.lit("")), ScanConfig.of(["EMAIL", "CREDIT_CARD", "PHONE", "IP_ADDRESS"])).alias("text"))


def card_luhn_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(table(spark, sf_dir, "documents"), ["source"], "CREDIT_CARD").where(validators.luhn(F.col("value"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def ip_valid_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(table(spark, sf_dir, "documents"), ["source"], "IP_ADDRESS").where(validators.ipv4(F.col("value"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.contains("text", F.lit("@")) & F.col("text").rlike(f"(?U){BY_KIND['EMAIL'].regex}")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def swift_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(table(spark, sf_dir, "documents"), ["doc_id"], "SWIFT_BIC").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


def aadhaar_verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_N12).alias("number")).select("c_custkey", "number", validators.verhoeff(F.col("number")).alias("valid"))


def aadhaar_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(f"concat('Aadhaar Number: ', {_N12})"), ["aadhaar"]).select("c_custkey", "start", "end", "confidence")


def card_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(f"concat('Invoice for card ', {_N16})"), ["card"]).select("c_custkey", "value", "confidence")


def phone_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "CASE c_custkey % 3 WHEN 0 THEN 'Phone: ' WHEN 1 THEN 'Contact support: ' ELSE 'Phone Number: ' END"
    text = f"concat({label}, '+1 555 123 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(text), ["phone"]).select("c_custkey", "value", "confidence")


def context_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('  Order\tNumber ', CAST(o_orderkey AS STRING), CASE o_orderkey % 2 WHEN 0 THEN ' credit   card' ELSE '' END)")
    window = plain(between(text, F.lit(0), F.lit(48)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", window.alias("window"), has_any(window, scoring.NEGATIVE).alias("negative"), scoring.points("CREDIT_CARD", F.col("o_orderkey") % 3 == 0, window, F.lit(True)).alias("points")
    )


def label_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat(CASE c_custkey % 2 WHEN 0 THEN 'CVV ' ELSE 'Valid thru: ' END, CASE c_custkey % 2 WHEN 0 THEN lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE concat(lpad(CAST(c_custkey % 15 AS STRING), 2, '0'), '/2', CAST(c_custkey % 10 AS STRING)) END)"
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(text), ["CVV", "CARD_EXPIRY"]).select("c_custkey", "type", "value", "confidence")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "lpad(CAST(c_custkey AS STRING), 16, '0')"
    text = f"CASE c_custkey % 5 WHEN 0 THEN concat('use AKIA', {n}) WHEN 1 THEN concat('t=ghp_', {n}, {n}, {n}) WHEN 2 THEN concat('k sk-live-', {n}) WHEN 3 THEN concat('Password: p', {n}) ELSE '-----BEGIN RSA PRIVATE KEY-----' END"
    found = _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(text), ["AWS_ACCESS_KEY", "ACCESS_TOKEN", "API_KEY", "PASSWORD", "PRIVATE_KEY"])
    return found.select("c_custkey", "type", "severity", "confidence", masks.mask_value(F.col("type"), F.col("value")).alias("masked"))


def national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    text = f"CASE c_custkey % 6 WHEN 0 THEN concat('ABCDE', {k}, 'F') WHEN 1 THEN concat('123-45-', {k}) WHEN 2 THEN concat('K123', {k}) WHEN 3 THEN concat('AB12', {k}, 'C') WHEN 4 THEN concat('900101-123', {k}) ELSE concat('HDFC012', {k}) END"
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], F.expr(text), ["PAN", "SSN", "PASSPORT", "UK_NINO", "KR_RRN", "IFSC"]).select("c_custkey", "type", "value", "confidence")


def address_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('Home Address: ', c_custkey, ' Park Road, Delhi - 600040') WHEN 1 THEN concat(c_custkey % 1000, ', Lake Street') WHEN 2 THEN 'We drove down the road into the city.' ELSE 'nothing here' END")
    return table(spark, sf_dir, "customer").select("c_custkey", scoring.address_points(text).alias("points"), scoring.has_pincode(text).alias("pin"), scoring.has_house_number(text).alias("house"))


def custom_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(table(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), ["custom"], [{"name": "long word", "regex": "[a-z]{18,}", "confidence": 90}, {"name": "unsafe", "regex": "(a+)+$"}])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cannot be scanned and patterns that cannot be run do not end the job; the other rows have all their detections."""
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('badge EMP-', c_custkey, ' of u', c_custkey, '@shop.example') WHEN 1 THEN CAST(unhex('FFFE41') AS STRING) ELSE repeat('ab', 20000) END")
    cfg = ScanConfig.of(["email", "custom"], [{"name": "badge", "regex": r"(?P<kind>EMP)-\d+"}, {"name": "endless", "regex": "(?:a|b)*c?"}, {"name": "broken", "regex": "([unclosed"}])
    found = scan.summaries(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), ["c_custkey"], cfg)
    return found.select("c_custkey", "status", "total_detections", "privacy_score")


#: A pattern whose repeats compete: what a text may cost is counted before it is run.
_COSTLY = "[a-z]*[a-z]*[a-z]*[a-z][.]"


def pattern_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that takes time without end on some texts, over whole documents: where it would, the row has status failed and its other detections."""
    cfg = ScanConfig.of(["ip_address", "custom"], [{"name": "end of sentence", "regex": _COSTLY}])
    text = F.expr("CASE WHEN doc_id % 50 = 7 THEN concat(text, ' ', repeat('ab', 10000), ' 10.0.0.1') ELSE text END")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return scan.summaries(rows, ["doc_id"], cfg).select("doc_id", "status", "total_detections")


def account_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers with a form of their own that no test table holds, composed from keys, between words and in a text of several lines."""
    hex40 = "lpad(lower(hex(c_custkey)), 40, '0')"
    value = f"CASE c_custkey % 5 WHEN 0 THEN concat('eyJ', lpad(CAST(c_custkey AS STRING), 12, 'a'), '.', lpad(CAST(c_custkey AS STRING), 12, 'b'), '.', lpad(CAST(c_custkey AS STRING), 12, 'c')) WHEN 1 THEN concat('DE', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), {_N16}) WHEN 2 THEN concat('c', c_custkey, '@okaxis') WHEN 3 THEN concat('0x', {hex40}) ELSE concat('00:1B:44:11:', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ':3A') END"
    text = F.expr(f"concat('line ', c_custkey, '\n', {value}, ' seen')")
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], text, ["JWT_TOKEN", "IBAN", "UPI_ID", "CRYPTO_WALLET", "MAC_ADDRESS"]).select("c_custkey", "type", "severity", "value", "start", "end", "confidence")


def request_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with tokens, with words read from an image, with a text only, and with all three, of which the tokens are used."""
    boxed = F.array(F.struct(F.lit("Card").alias("text"), F.array(*map(F.lit, (10.0, 50.0, 40.0, 20.0))).alias("bbox")), F.struct(F.expr(_N16).alias("text"), F.array(*map(F.lit, (60.0, 50.0, 180.0, 20.0))).alias("bbox")), F.struct(F.lit("lost").alias("text"), F.array(F.lit(1.0)).alias("bbox")))
    seen = F.array(F.struct(F.expr("concat('u', c_custkey, '@shop.example')").alias("text"), *[F.lit(v).alias(n) for n, v in zip("xywh", (10.0, 10.0, 200.0, 20.0), strict=True)]))
    k = F.col("c_custkey") % 5
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.when(k.isin(0, 3), boxed).alias("tokens"), F.when(k.isin(1, 3), seen).alias("ocr"), F.when(k.isin(2, 3), F.expr("concat('SSN 123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))")).alias("text"))
    found = scan.request_detections(rows, ["c_custkey"], ScanConfig.of(["card", "email", "ssn"]))
    return found.select("c_custkey", "type", "text", "confidence", "severity", F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"), "status", "attempts")


def image_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers to requests with a striped image, in which an address is painted over, and with a text instead of an image."""
    seen = F.array(F.struct(F.expr("concat('u', c_custkey, '@shop.example')").alias("text"), *[F.lit(v).alias(n) for n, v in zip("xywh", (4.0, 4.0, 40.0, 8.0), strict=True)]))
    stripes = F.unhex(F.repeat(F.lit("000000FFFFFF"), F.when(F.col("c_custkey") % 2 == 0, 480).otherwise(479)))
    said = F.expr("concat('SSN 123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))")
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.expr("CAST(null AS array<struct<text:string,bbox:array<double>>>)").alias("tokens"), seen.alias("ocr"), said.alias("text"), F.lit(16).alias("height"), F.lit(60).alias("width"), stripes.alias("data"))
    done = scan.responses(rows, ["c_custkey"], ScanConfig.of(["email", "ssn"], mode="redact"))
    ink = "".join(f"{v:02X}" for v in images.INK)
    shown = done.select("c_custkey", "status", "privacy_score", "critical_count", (F.size(F.split(F.hex("data"), ink)) - 1).alias("painted"), F.explode_outer("detections").alias("d"))
    return shown.select("c_custkey", "status", "privacy_score", "critical_count", F.when(F.col("painted") >= 0, F.col("painted")).alias("painted"), "d.type", "d.text", "d.attempts", F.col("d.verification_passed").alias("verified"))


def _located_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers in positioned tokens: on one line behind a label, wrapped over two lines, and below a label."""
    word = lambda text, x, y, w: F.struct(F.expr(text).alias("text"), *[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, y, w, 20), strict=True)])
    part = lambda i: f"substring({_N16}, {4 * i + 1}, 4)"
    row = F.array(word("'Card'", 10, 50, 40), *[word(part(i), 60 + 50 * i, 50, 45) for i in range(4)])
    wrapped = F.array(word(f"substring({_N16}, 1, 8)", 10, 50, 90), word(f"substring({_N16}, 9, 8)", 10, 80, 90))
    below = F.array(word("'Card'", 10, 20, 40), *[word(part(i), 10 + 50 * i, 50, 45) for i in range(4)])
    kind = F.col("c_custkey") % 3
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.when(kind == 0, row).when(kind == 1, wrapped).otherwise(below).alias("tokens"))
    return spatial.token_detections(rows, ["c_custkey"], ScanConfig.of(["card"]))


def located_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _located_cards(spark, sf_dir)
    return found.select("c_custkey", "type", "text", "confidence", *[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])


def enabled_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('mail u', c_custkey, '@shop.example card ', {_N16})")
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], text, ["E-Mail"]).select("c_custkey", "type", "value")


def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('token ABCD0', lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0'))")
    return _found(table(spark, sf_dir, "customer"), ["c_custkey"], text, ["IFSC", "SWIFT_BIC"]).select("c_custkey", "type", "start", "end")


def type_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.expr("element_at(array('  Credit  Card ', 'uid', 'e-mail', 'Phone Number', 'custom', 'c_name'), CAST(c_custkey % 6 + 1 AS INT))")
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_type_column(F.when(named == "c_name", F.col("c_name")).otherwise(named)).alias("type"))


def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"CREDIT_CARD": _N16, "AADHAAR": _N12, "PHONE": f"concat('+', {_N12})", "EMAIL": "concat('c', c_custkey, '@shop.example')", "PASSWORD": "c_name", "CVV": "CAST(c_custkey % 1000 AS STRING)", "IBAN": f"concat('DE', {_N16})", "ADDRESS": "concat(c_custkey, ', Lake Road')", "CUSTOM_PATTERN": "c_name", "PASSPORT": "c_name"}
    return table(spark, sf_dir, "customer").select("c_custkey", *[masks.mask_value(F.lit(k), F.expr(v)).alias(k.lower()) for k, v in kinds.items()], masks.mask_for_client(F.lit("PHONE"), F.expr(_N12)).alias("client_phone"))


def mask_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", masks.mask_for_log(F.col("n_name")).alias("log"), masks.mask_candidate(F.col("n_name")).alias("candidate"))


def privacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("element_at(array('low', 'medium', 'high', 'critical'), CAST(l_linenumber % 4 + 1 AS INT))")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(scan.severity_weight(severity)).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if(severity == "critical").alias("critical_count"))
    return grouped.select("l_orderkey", "critical_count", scan.privacy_score(F.col("w"), F.col("n")).alias("privacy_score"), scan.client_score(F.col("w"), F.col("n")).alias("client_score"))


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = geometry.box(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(20.0), F.lit(10.0))
    b = geometry.box(F.lit(25.0), F.lit(4.0), F.lit(10.0), F.lit(8.0))
    u, p = geometry.union_box(F.array(a, b)), geometry.pad_box(a, 0.5, F.lit(60.0), F.lit(20.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geometry.iou(a, b), 6).alias("iou"), F.round(geometry.y_overlap(a, b), 6).alias("y_overlap"), u["w"].alias("union_w"), u["h"].alias("union_h"), p["x"].alias("pad_x"), p["w"].alias("pad_w"), p["h"].alias("pad_h"))


def protection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", F.expr("element_at(array('low', 'medium', 'high', 'critical'), CAST(p_partkey % 4 + 1 AS INT))").alias("s"), F.expr("element_at(array('blur', 'pixelate', 'redact', 'frosted'), CAST(p_size % 4 + 1 AS INT))").alias("m"), (F.col("p_partkey") % 3 + 1).cast("int").alias("a"))
    return base.select("p_partkey", images.protection_plan(F.col("s"), F.col("m"), F.col("a")).alias("p")).select("p_partkey", "p.action", "p.radius", "p.blocks")


def verify_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", images.is_protected(F.col("p_size") / 10.0, (F.col("p_partkey") % 30) / 10.0).alias("safe"))


def ocr_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda dx: F.array(F.struct(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("text"), (F.col("p_size") * 2).cast("string").alias("conf"), (F.lit(10.0) + dx).alias("left"), F.lit(5.0).alias("top"), (F.col("p_partkey") % 4).cast("double").alias("width"), F.lit(8.0).alias("height")))
    first, second = ocr_tokens(raw(0)), ocr_tokens(raw(F.col("p_partkey") % 5), 20.0, 2.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(first).alias("first"), F.size(second).alias("second"), F.size(merge_tokens(first, second)).alias("merged"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spatial.group_lines(spatial.tokens_from_text(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", lines.alias("l")).select("item_id", F.size("l").alias("lines"), F.aggregate("l", F.lit(0), lambda a, x: a + F.size(x)).alias("tokens"))


def pii_by_language_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: documents with a valid card by language and source, with totals."""
    card = F.exists(spans(F.col("text"), f"(?U){BY_KIND['CREDIT_CARD'].regex}"), lambda m: validators.luhn(m["value"]))
    return table(spark, sf_dir, "documents").select("lang", "source", card.cast("int").alias("hit")).rollup("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("hit").alias("hits"))


def labels_against_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: labels joined with whether a document holds an at sign and a digit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("@")).alias("at"), F.col("text").rlike("[0-9]").alias("digit"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "at", "digit").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows."""
    return windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by user."""
    return sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (
    scan_documents, scan_pages, scan_conversations, document_summaries, report_documents, report_totals, redacted_conversations, card_luhn_by_source, ip_valid_by_source,
    email_documents, swift_hits, aadhaar_verhoeff, aadhaar_confidence, card_confidence, phone_confidence, context_points, label_anchored, secrets, national_ids, address_scores, custom_patterns,
    failure_isolation, pattern_effort, account_ids, request_scans, image_responses, located_cards, enabled_isolation, overlap_resolve, type_normalize, mask_values, mask_logs, privacy_scores, box_geometry, protection_plan, verify_regions, ocr_token_filter, token_lines,
    pii_by_language_and_source, labels_against_pii, event_windows, event_sessions,
)}

_ALIAS_SQL = " ".join(f"WHEN k = '{a}' OR replace(k, ' ', '_') = '{a}' THEN '{t}'" for a, t in ALIASES.items())
_WEIGHTS = f"CASE l_linenumber % 4 WHEN 0 THEN {RISK['low']} WHEN 1 THEN {RISK['medium']} WHEN 2 THEN {RISK['high']} ELSE {RISK['critical']} END"
_CARD = r"regexp_extract_all(" + _LETTERS + r", '\b(?:\d[ -]?){12,18}\d\b')"



_K4 = _digits("c_custkey", 7919, 4)
#: Messages of all types, several in one text, with words for and against them, on both sides of the limits; by key, in both dialects.
_MESSAGES = [
    f"concat('Card number: ', {_N16}, ' valid thru 0', c_custkey % 10, '/2', c_custkey % 10, ' CVV ', {_K4})",
    f"concat('Invoice for card ', {_N16}, ', order number ', {_N12})",
    f"concat('ref ', {_N16}, ' and ', {_N12}, ' and ', substr({_N12}, 1, 4), '-', substr({_N12}, 5, 4), '-', substr({_N12}, 9, 4))",
    f"concat('My Aadhaar Number: ', {_N12}, ', identity of ', c_name)",
    f"concat('Phone: +91 98', {_N12}, '; mobile number 98765 4', {_K4}, ', call 555 123 ', {_K4}, ' on date')",
    f"concat('server host ', c_custkey % 300, '.0.', c_custkey % 256, '.7 and ip address 10.1.', c_custkey % 256, '.', c_custkey % 260, ' mac 00:1B:44:11:3A:', right({_K4}, 2))",
    f"concat('SWIFT code ABCDEF', substr({_K4}, 1, 2), ' IFSC HDFC0', right({_N12}, 6), ' IBAN DE', right({_K4}, 2), {_N16}, ' upi: c', c_custkey, '@okaxis')",
    f"concat('mail u', c_custkey, '@shop.example, PAN ABCDE', {_K4}, 'F, SSN 123-45-', {_K4}, ', passport K123', {_K4}, ', AB12', {_K4}, 'C, 900101-123', {_K4})",
    f"concat('Home Address: ', c_custkey % 500, ', Lake Street, Delhi - 600', right({_K4}, 3), '\n', 'Password: p', {_K4}, ' sk-live-', {_N16}, ' AKIA', {_N16})",
    f"concat('exp ', substr({_K4}, 1, 2), ' / ', right({_K4}, 2), '; expiry 1', c_custkey % 4, '/27, cvc', ' is ', {_K4}, ' ghp_', {_N12}, {_N12}, {_N12}, ' wallet 0x', lpad({_N12}, 40, 'a'))",
]
_MESSAGE = f"CASE c_custkey % {len(_MESSAGES)} " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MESSAGES[:-1])) + f" ELSE {_MESSAGES[-1]} END"


def scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of messages that hold all types of the catalog but for private keys and web tokens."""
    return _flat(scan.detections(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MESSAGE).alias("text")), ["c_custkey"]))


def message_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summaries(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MESSAGE).alias("text")), ["c_custkey"])


def message_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.report_totals(scan_messages(spark, sf_dir))


def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = ScanConfig.of([p.kind for p in PATTERNS])
    return dealt(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.expr(_MESSAGE).alias("text")).select("c_custkey", scan.redact_text(F.col("text"), cfg).alias("text"))


def client_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's types, and how many detections of each the messages hold and in how many messages; also those without any."""
    shown = client_messages(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("messages"))
    counted = client.client_types(spark).join(F.broadcast(shown), "type", "left")
    return counted.select("type", "label", "severity", "enabled", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n", "messages")])


def client_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the client lists them, all its types on."""
    found = scan.detections(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MESSAGE).alias("text")), ["c_custkey"])
    return client.client_detections(found, ["c_custkey"], F.lit(1024), F.lit(512), client.CLIENT_TYPES)


def client_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located cards as the client draws them on an image of 1024 by 512."""
    return client.client_detections(_located_cards(spark, sf_dir), ["c_custkey"], F.lit(1024), F.lit(512))


QUERIES |= {f.__name__: f for f in (scan_messages, message_summaries, message_totals, redacted_messages, client_types, client_messages, client_boxes)}


def _scan_sql(source: str, keys: list[str], text: str = "text", kinds: list[str] | None = None) -> str:
    return full.found_sql(source, keys, text, _sql_luhn("digits"), f"length(digits) = 12 AND {_sql_verhoeff('digits')}", _LETTERS, kinds)


_SAID = f"(SELECT c_custkey, {_MESSAGE} AS text FROM customer)".replace("\\n", "\n")
_MESSAGES_FOUND = _scan_sql(_SAID, ["c_custkey"])
_DOCUMENTS, _TURNS = _scan_sql("documents", ["doc_id"]), _scan_sql("conversations", ["conv_id", "turn"])

ORACLES = {
    "scan_documents": full.detections_sql(_DOCUMENTS, ["doc_id"]),
    "scan_pages": full.detections_sql(_scan_sql("pages", ["page_id"], "html"), ["page_id"]),
    "scan_conversations": full.detections_sql(_TURNS, ["conv_id", "turn"]),
    "document_summaries": full.summaries_sql(_DOCUMENTS, ["doc_id"]),
    "report_documents": full.report_sql(_DOCUMENTS),
    "report_totals": full.totals_sql(_TURNS),
    "redacted_conversations": full.redacted_sql(_scan_sql("conversations", ["conv_id", "turn"], kinds=["EMAIL", "CREDIT_CARD", "PHONE", "IP_ADDRESS"]), ["conv_id", "turn"]),
    "scan_messages": full.detections_sql(_MESSAGES_FOUND, ["c_custkey"]),
    "message_summaries": full.summaries_sql(_MESSAGES_FOUND, ["c_custkey"]),
    "message_totals": full.totals_sql(_MESSAGES_FOUND),
    "redacted_messages": full.redacted_sql(_scan_sql(_SAID, ["c_custkey"], kinds=[p.kind for p in PATTERNS]), ["c_custkey"]),
    "card_luhn_by_source": f"WITH c AS (SELECT source, unnest({_CARD}) AS v FROM documents), d AS (SELECT source, regexp_replace(v, '[^0-9]', '', 'g') AS s FROM c) SELECT source, count(*) AS n FROM d WHERE {_sql_luhn('s')} GROUP BY source",
    "ip_valid_by_source": rf"WITH c AS (SELECT source, unnest(regexp_extract_all({_LETTERS}, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b')) AS v FROM documents) SELECT source, count(*) AS n FROM c WHERE list_bool_and(list_transform(string_split(v, '.'), lambda p: CAST(p AS INT) <= 255 AND (length(p) = 1 OR p[1] <> '0'))) GROUP BY source",
    "email_documents": rf"SELECT source, lang, count(*) AS n FROM documents WHERE regexp_matches({_LETTERS}, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b') GROUP BY source, lang",
    "swift_hits": rf"WITH c AS (SELECT doc_id, unnest(regexp_extract_all({_LETTERS}, '\b[A-Z]{{4}}[A-Z]{{2}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?\b')) AS v FROM documents) SELECT doc_id, count(*) AS n, min(v) AS least FROM c GROUP BY doc_id",
    "aadhaar_verhoeff": f"WITH c AS (SELECT c_custkey, {_N12} AS number FROM customer) SELECT c_custkey, number, {_sql_verhoeff('number')} AS valid FROM c",
    "aadhaar_confidence": f"WITH c AS (SELECT c_custkey, {_N12} AS number FROM customer) SELECT c_custkey, 16 AS start, 28 AS \"end\", CASE WHEN {_sql_verhoeff('number')} THEN 0.99 ELSE 0.48 END AS confidence FROM c",
    "card_confidence": f"WITH c AS (SELECT c_custkey, {_N16} AS value FROM customer) SELECT c_custkey, value, 0.75 AS confidence FROM c WHERE {_sql_luhn('value')}",
    "phone_confidence": "SELECT c_custkey, '+1 555 123 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS value, CASE c_custkey % 3 WHEN 0 THEN 0.45 ELSE 0.85 END AS confidence FROM customer WHERE c_custkey % 3 <> 1",
    "context_points": "SELECT o_orderkey, 'order number ' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN ' credit card' ELSE '' END AS \"window\", true AS negative, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 43 END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 56 ELSE 0 END END AS points FROM orders",
    "label_anchored": "SELECT c_custkey, 'CVV' AS type, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS value, 0.6 AS confidence FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'CARD_EXPIRY', lpad(CAST(c_custkey % 15 AS STRING), 2, '0') || '/2' || (c_custkey % 10), 0.6 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 15 BETWEEN 1 AND 12",
    "secrets": """SELECT c_custkey,
        CASE c_custkey % 5 WHEN 0 THEN 'AWS_ACCESS_KEY' WHEN 1 THEN 'ACCESS_TOKEN' WHEN 2 THEN 'API_KEY' WHEN 3 THEN 'PASSWORD' ELSE 'PRIVATE_KEY' END AS type,
        CASE c_custkey % 5 WHEN 1 THEN 'high' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
        CASE c_custkey % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.97 WHEN 2 THEN 0.97 WHEN 3 THEN 0.9 ELSE 0.99 END AS confidence,
        CASE c_custkey % 5 WHEN 0 THEN 'AKI-••••••••••••' WHEN 1 THEN 'ghp_••••••••••••' WHEN 2 THEN 'sk--••••••••••••' WHEN 3 THEN '••••••••••••' ELSE '-----BEGIN PRIVATE KEY----- ••••' END AS masked FROM customer""",
    "national_ids": """WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS k FROM customer) SELECT c_custkey,
        CASE c_custkey % 6 WHEN 0 THEN 'PAN' WHEN 1 THEN 'SSN' WHEN 2 THEN 'PASSPORT' WHEN 3 THEN 'UK_NINO' WHEN 4 THEN 'KR_RRN' ELSE 'IFSC' END AS type,
        CASE c_custkey % 6 WHEN 0 THEN 'ABCDE' || k || 'F' WHEN 1 THEN '123-45-' || k WHEN 2 THEN 'K123' || k WHEN 3 THEN 'AB12' || k || 'C' WHEN 4 THEN '900101-123' || k ELSE 'HDFC012' || k END AS value,
        CASE c_custkey % 6 WHEN 0 THEN 0.92 WHEN 1 THEN 0.9 WHEN 2 THEN 0.72 WHEN 3 THEN 0.88 ELSE 0.9 END AS confidence FROM c""",
    "address_scores": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey >= 1000000 THEN 90 ELSE 100 END WHEN 1 THEN 30 WHEN 2 THEN 36 ELSE 0 END AS points, c_custkey % 4 = 0 AND c_custkey < 1000000 AS pin, c_custkey % 4 = 1 AS house FROM customer",
    "custom_patterns": "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[a-z]{18,}')) AS n FROM documents) SELECT doc_id, n, 0.9 AS confidence FROM c WHERE n > 0",
    "failure_isolation": "SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'failed' ELSE 'completed' END AS status, CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 0 END AS total_detections, CASE c_custkey % 3 WHEN 0 THEN 99.0 WHEN 1 THEN 50.0 ELSE 100.0 END AS privacy_score FROM customer",
    "pattern_effort": rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN text || ' ' || repeat('ab', 10000) || ' 10.0.0.1' ELSE text END AS text FROM documents),
        e AS (SELECT doc_id, text, coalesce(list_sum(list_transform(regexp_extract_all(text, '(?i)[a-z]+'), lambda x: pow(length(x), 4))), 0) > 4e8 AS failed FROM d),
        i AS (SELECT doc_id, len(list_filter(regexp_extract_all({_LETTERS}, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b'), lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda p: CAST(p AS INT) <= 255 AND (length(p) = 1 OR p[1] <> '0'))))) AS ips FROM d)
        SELECT doc_id, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status, CAST(ips + CASE WHEN failed THEN 0 ELSE len(regexp_extract_all(text, '[a-z]+[.]')) END AS INT) AS total_detections FROM e JOIN i USING (doc_id)""",
    "account_ids": rf"""WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'eyJ' || lpad(CAST(c_custkey AS STRING), 12, 'a') || '.' || lpad(CAST(c_custkey AS STRING), 12, 'b') || '.' || lpad(CAST(c_custkey AS STRING), 12, 'c')
            WHEN 1 THEN 'DE' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || {_N16} WHEN 2 THEN 'c' || c_custkey || '@okaxis' WHEN 3 THEN '0x' || lpad(lower(hex(c_custkey)), 40, '0') ELSE '00:1B:44:11:' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ':3A' END AS v FROM customer),
        s AS (SELECT c_custkey, 'line ' || c_custkey || chr(10) || v || ' seen' AS text FROM t),
        p AS (SELECT * FROM (VALUES ('JWT_TOKEN', 'high', 0.96, '\beyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\b'), ('IBAN', 'high', 0.9, '\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\b'),
            ('UPI_ID', 'high', 0.95, '\b[A-Za-z0-9.\-_]{{2,}}@(?:okhdfcbank|oksbi|okaxis|okicici|paytm|ybl|upi|apl|axl)\b'), ('CRYPTO_WALLET', 'high', 0.85, '\b(?:0x[a-fA-F0-9]{{40}}|bc1[a-z0-9]{{25,59}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}})\b'),
            ('MAC_ADDRESS', 'low', 0.9, '\b(?:[0-9A-Fa-f]{{2}}:){{5}}[0-9A-Fa-f]{{2}}\b')) AS x(type, severity, confidence, regex)),
        m AS (SELECT c_custkey, type, severity, CAST(confidence AS DOUBLE) AS confidence, text, unnest(regexp_extract_all(text, regex)) AS value FROM s, p)
        SELECT c_custkey, type, severity, value, strpos(text, value) - 1 AS start, strpos(text, value) - 1 + length(value) AS "end", confidence FROM m""",
    "request_scans": f"""WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, {_N16} AS n FROM customer)
        SELECT c_custkey, 'CREDIT_CARD' AS type, 'XXXX XXXX XXXX ' || right(n, 4) AS text, 0.85 AS confidence, 'critical' AS severity, 57.6 AS x, 184.8 AS w, 'protected' AS status, 1 AS attempts FROM c WHERE k IN (0, 3) AND {_sql_luhn('n')}
        UNION ALL SELECT c_custkey, 'EMAIL', 'u•••@s••.•••', 0.98, 'medium', 7.6, 204.8, 'protected', 1 FROM c WHERE k = 1
        UNION ALL SELECT c_custkey, 'SSN', 'XXX-XX-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 0.9, 'critical', 0.0, 0.0, 'protected', 1 FROM c WHERE k = 2""",
    "image_responses": f"""SELECT c_custkey, 'completed' AS status, CAST(round(100 - 0.06 * {RISK['medium']}, 1) AS DOUBLE) AS privacy_score, 0 AS critical_count, 41 * 9 AS painted, 'EMAIL' AS type, 'u•••@s••.•••' AS text, 1 AS attempts, true AS verified
        FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'completed', CAST(round(100 - 0.06 * {RISK['critical']}, 1) AS DOUBLE), 1, NULL, 'SSN', 'XXX-XX-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 1, true FROM customer WHERE c_custkey % 2 = 1""",
    "located_cards": f"""WITH c AS (SELECT c_custkey, c_custkey % 3 AS k, {_N16} AS n FROM customer) SELECT c_custkey, 'CREDIT_CARD' AS type, 'XXXX XXXX XXXX ' || right(n, 4) AS text,
        CASE k WHEN 1 THEN 0.6 ELSE 0.85 END AS confidence, CASE k WHEN 0 THEN 57.6 WHEN 1 THEN 4.0 ELSE 7.6 END AS x, CASE k WHEN 1 THEN 44.0 ELSE 47.6 END AS y,
        CASE k WHEN 1 THEN 102.0 ELSE 199.8 END AS w, CASE k WHEN 1 THEN 62.0 ELSE 24.8 END AS h FROM c WHERE {_sql_luhn('n')}""",
    "enabled_isolation": "SELECT c_custkey, 'EMAIL' AS type, 'u' || c_custkey || '@shop.example' AS value FROM customer",
    "overlap_resolve": "SELECT c_custkey, 'IFSC' AS type, 6 AS start, 17 AS \"end\" FROM customer",
    "type_normalize": f"WITH n AS (SELECT c_custkey, c_name, ['  Credit  Card ', 'uid', 'e-mail', 'Phone Number', 'custom', 'c_name'][c_custkey % 6 + 1] AS t FROM customer), m AS (SELECT c_custkey, CASE WHEN t = 'c_name' THEN c_name ELSE t END AS t FROM n), p AS (SELECT c_custkey, t, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS k FROM m) SELECT c_custkey, CASE {_ALIAS_SQL} ELSE upper(trim(t)) END AS type FROM p",
    "mask_values": f"""SELECT c_custkey, 'XXXX XXXX XXXX ' || right({_N16}, 4) AS credit_card, 'XXXX XXXX ' || right({_N12}, 4) AS aadhaar, '+•• •••••' || right({_N12}, 4) AS phone, 'c•••@s••.•••' AS email,
        repeat('•', least(greatest(length(c_name), 8), 12)) AS password, '•••' AS cvv, 'DE••••••••' || right({_N16}, 2) AS iban, c_custkey || ' •••••••, •••' AS address,
        repeat('•', least(greatest(length(c_name), 4), 16)) AS custom_pattern, '[REDACTED]' AS passport, '+•• •••••' || right({_N12}, 5) AS client_phone FROM customer""",
    "mask_logs": "SELECT n_nationkey, CASE WHEN length(n_name) <= 4 THEN repeat('•', length(n_name)) ELSE left(n_name, 2) || repeat('•', length(n_name) - 4) || right(n_name, 2) END AS log, CASE WHEN length(n_name) <= 8 THEN repeat('*', length(n_name)) ELSE left(n_name, 4) || repeat('*', length(n_name) - 8) || right(n_name, 4) END AS candidate FROM nation",
    "privacy_scores": f"WITH g AS (SELECT l_orderkey, sum({_WEIGHTS}) AS w, count(*) FILTER (l_linenumber % 4 = 3) AS critical_count FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, critical_count, round(greatest(0.0, 100.0 - CAST(w AS DOUBLE) * 0.06), 1) AS privacy_score, CAST(least(99, 100 - greatest(2, floor(CAST(w AS DOUBLE) * 0.06 + 0.5))) AS INT) AS client_score FROM g",
    "box_geometry": """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y,
        greatest(0.0, least(l_quantity + 20, 35.0) - greatest(l_quantity, 25.0)) AS iw, greatest(0.0, least(l_linenumber + 10.0, 12.0) - greatest(CAST(l_linenumber AS DOUBLE), 4.0)) AS ih FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN iw * ih > 0 THEN round(iw * ih / (280.0 - iw * ih), 6) ELSE 0.0 END AS iou, round(ih / 8.0, 6) AS y_overlap,
        greatest(x + 20, 35.0) - least(x, 25.0) AS union_w, greatest(y + 10, 12.0) - least(y, 4.0) AS union_h, greatest(0.0, x - 5) AS pad_x,
        greatest(0.0, least(60.0 - greatest(0.0, x - 5), 30.0)) AS pad_w, least(20.0 - greatest(0.0, y - 5), 20.0) AS pad_h FROM b""",
    "protection_plan": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS s, p_size % 4 AS m, p_partkey % 3 AS a FROM part),
        q AS (SELECT *, CASE WHEN s = 3 OR m = 3 THEN 'frost' WHEN m = 2 THEN 'redact' WHEN m = 1 THEN 'pixelate' ELSE 'blur' END AS action, CASE a WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 2 END AS b FROM p)
        SELECT p_partkey, action, CAST(CASE action WHEN 'frost' THEN 14 WHEN 'redact' THEN 12 WHEN 'pixelate' THEN 0 ELSE round((CASE s WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 18 END) * (1 + 0.6 * a), 6) END AS DOUBLE) AS radius,
        CASE WHEN action = 'pixelate' OR (s = 3 AND a > 0) THEN b ELSE 0 END AS blocks FROM q""",
    "verify_regions": "SELECT p_partkey, (p_partkey % 30) / 10.0 <= greatest(1.5, p_size / 10.0 * 0.35) AS safe FROM part",
    "pii_by_language_and_source": f"WITH d AS (SELECT lang, source, list_bool_or(list_transform(list_transform({_CARD}, lambda v: regexp_replace(v, '[^0-9]', '', 'g')), lambda s: {_sql_luhn('s')})) AS hit FROM documents) SELECT lang, source, count(*) AS docs, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits FROM d GROUP BY ROLLUP (lang, source)",
    "labels_against_pii": "SELECT quality, toxic, contains(text, '@') AS \"at\", regexp_matches(text, '[0-9]') AS digit, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '10 minutes' THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, sum(s) AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "token_lines": r"SELECT item_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ ]'))) AS lines, len(regexp_extract_all(text, '[^ \n]+')) AS tokens FROM benchmark",
    "ocr_token_filter": "WITH p AS (SELECT p_partkey, CASE WHEN p_size * 2 >= 30 AND p_partkey % 4 > 0 THEN 1 ELSE 0 END AS first, CASE WHEN p_size * 2 >= 20 AND p_partkey % 4 > 0 THEN 1 ELSE 0 END AS second FROM part) SELECT p_partkey, first, second, first + second AS merged FROM p",
}

_CLIENT_SEVERITY = "CASE type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in client.CLIENT_TYPES.items()) + " END"
_CLIENT_ROWS = ", ".join(f"('{k}', '{label}', '{s}', {k in client.ENABLED})" for k, (label, s) in client.CLIENT_TYPES.items())


def _client_sql(found: str, kinds: tuple[str, ...]) -> str:
    named = ", ".join(f"'{k}'" for k in client.CLIENT_TYPES)
    kept = ", ".join(f"'{k}'" for k in kinds)
    return f"""SELECT c_custkey, type, masked, confidence, {_CLIENT_SEVERITY} AS severity, true AS protected, CASE WHEN w > 0 THEN x / 1024 ELSE 0 END AS x, CASE WHEN h > 0 THEN y / 512 ELSE 0 END AS y, w / 1024 AS width, h / 512 AS height
        FROM (SELECT c_custkey, CASE WHEN type IN ({named}) THEN type ELSE 'CUSTOM' END AS type, text AS masked, floor(CAST(confidence AS DOUBLE) * 1000 + 0.5) / 10 AS confidence, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM ({found}))
        WHERE type IN ({kept})"""


ORACLES |= {
    "client_messages": _client_sql(ORACLES["scan_messages"], tuple(client.CLIENT_TYPES)),
    "client_boxes": _client_sql(ORACLES["located_cards"], client.ENABLED),
}

ORACLES["client_types"] = f"""SELECT t.type, label, severity, enabled, coalesce(n, 0) AS n, coalesce(messages, 0) AS messages FROM (VALUES {_CLIENT_ROWS}) AS t(type, label, severity, enabled)
    LEFT JOIN (SELECT type, count(*) AS n, count(DISTINCT c_custkey) AS messages FROM ({ORACLES["client_messages"]}) GROUP BY type) m ON m.type = t.type"""

QUERIES |= image_queries.QUERIES
ORACLES |= image_queries.ORACLES
QUERIES |= token_queries.QUERIES
ORACLES |= token_queries.oracles(_sql_luhn("digits"), f"length(digits) = 12 AND {_sql_verhoeff('digits')}", _LETTERS)
QUERIES |= extension_queries.QUERIES
_RATED = _scan_sql("documents", ["doc_id", "source", "lang"], kinds=["EMAIL", "IP_ADDRESS", "SWIFT_BIC", "CREDIT_CARD"])
ORACLES |= extension_queries.oracles(_RATED, full.summaries_sql(_RATED, ["doc_id", "source", "lang"]))
