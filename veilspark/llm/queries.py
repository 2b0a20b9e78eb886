"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, html_extract, language_id, near_dedup, packing, pii, quality, sentence_pieces, sharding, token_counts, url_filter, vector_codes
from .common import durable, ensure_checkpoint_dir, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE, capacity=2048, end_id=1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents under one tokenizer version, then revise, delete and insert anew, every batch sent twice: the totals by key.

    The first batch counts an end id with every document; the second takes it out of all counts and moves the documents of languages
    other than English to version 2 of the tokenizer. The third deletes a third of the documents, with the text they have, and those of
    version 2 without text; the fourth inserts the third again, but for the latter. The first two batches
    are folded into a snapshot. The state lives in the shared folder and is removed at the end.
    """
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    counts = durable(token_counts.count_tokens(docs, BPE, "byte_bpe_50k/1"))
    ended = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    moved = F.expr("coalesce(lang, '') <> 'en'")
    revised = counts.withColumn("tokenizer_version", F.when(moved, "byte_bpe_50k/2").otherwise(F.col("tokenizer_version")))
    third, empty = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, F.lit(False)), moved & (F.col("n_bytes") == 0)
    batches = {
        "0001": token_counts.inserts(ended),
        "0002": token_counts.revisions(ended, revised),
        "0003": token_counts.deletes(revised.where(third | empty)),
        "0004": token_counts.inserts(revised.where(third & ~empty)),
    }
    rollup = token_counts.Rollup(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}")
    for batch_id, changes in batches.items():
        rollup.apply(batch_id, changes)
        rollup.apply(batch_id, changes)
        if batch_id == "0002":
            rollup.fold()
    totals = durable(rollup.totals())
    rollup.remove()
    return totals


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of the id, stand for earlier batches; the rest arrives and is looked up."""
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), history)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


#: The rules of op11: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations"))).drop("held")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"), positions=8, entries=16, rounds=6)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

_SPACE = r"[\x20\x09-\x0D]"


def _op12_sql() -> str:
    """The repair as a recursive query: for every conversation, row and state of the grammar the least (cost, edits)."""
    turn = lambda s: f"CASE WHEN {s} = 2 THEN 3 ELSE 2 END"
    inserted = "SELECT {0}, state, cost, audit FROM {1} UNION ALL SELECT {0}, " + turn("state") + ", cost + 3, audit || 'I' FROM {1} UNION ALL SELECT {0}, CASE WHEN state = 2 THEN 2 ELSE 3 END, cost + 6, audit || 'II' FROM {1} WHERE state < 2"
    return f"""
        WITH RECURSIVE drawn AS (
            SELECT *, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
                   unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM drawn WHERE lot > 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, regexp_replace(text, '{_SPACE}+$', '') AS bare
            FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM judged GROUP BY ALL
        ), begun AS (SELECT conv_id, 0 AS state, 0 AS cost, '' AS audit FROM counts
        ), walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, state, cost, audit FROM ({inserted.format("conv_id", "begun")})
            UNION ALL
            SELECT conv_id, i, state, best.cost, best.audit FROM (
                SELECT conv_id, i, state, min({{'cost': cost, 'audit': audit}}) AS best FROM (
                    WITH edited AS (
                        SELECT j.conv_id, j.i, e.state, w.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || e.edit AS audit
                        FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1, LATERAL (
                            SELECT w.state AS state, 4 AS cost, 'D' AS edit
                            UNION ALL SELECT {turn("w.state")}, 3, 'R' WHERE j.fault NOT IN ('blank', 'duplicate')
                            UNION ALL SELECT CASE j.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 0, 'K'
                            WHERE j.fault NOT IN ('blank', 'duplicate') AND (w.state, j.c) IN ((0, 's'), (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u'))
                        ) e
                    ) {inserted.format("conv_id, i", "edited")}
                ) GROUP BY conv_id, i, state
            )
        ), ended AS (
            SELECT c.conv_id, min({{'cost': w.cost, 'audit': w.audit}}) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
            WHERE w.state IN (0, 3) GROUP BY c.conv_id
        ), edits AS (
            SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS p FROM ended
        ), kept AS (
            SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place FROM edits
        ), texts AS (
            SELECT k.conv_id, string_agg(CASE WHEN k.edit = 'K' THEN j.role WHEN k.place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN k.edit = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY k.p) AS whole
            FROM kept k LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM k.conv_id AND j.i = k.i WHERE k.edit <> 'D' GROUP BY k.conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    """


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text in UTF-8, unsigned: the polynomial's remainder, bit by bit."""
    byte = "xor(c, CAST(('0x' || substr(h, CAST(2 * b - 1 AS INTEGER), 2)) AS BIGINT))"
    bits = "list_reduce(list_prepend({0}, range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    step = bits.format(byte)
    return f"(SELECT xor(list_reduce(list_prepend(4294967295, range(1, length(h) // 2 + 1)), lambda c, b: {step}), 4294967295) FROM (SELECT hex({text}) AS h))"


def _op13_sql() -> str:
    """The rounds one after another, each with all distances."""
    nearest = """
        SELECT vec_id, label, part, v, min(struct_pack(d := list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - c[k]) * (v[k] - c[k]))), e := entry)) AS best
        FROM parts JOIN book{0} USING (part) GROUP BY ALL"""
    steps = []
    for n in range(1, 7):
        steps.append(f"""
        near{n} AS MATERIALIZED ({nearest.format(n - 1)}),
        means{n} AS (SELECT part, best.e AS entry, k, sum(v[k]) AS total, count(*) AS n FROM near{n}, range(1, 9) r(k) WHERE k <= len(v) GROUP BY ALL),
        book{n} AS MATERIALIZED (
            SELECT part, entry, coalesce(f.c, b.c) AS c FROM book{n - 1} b
            LEFT JOIN (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM means{n} GROUP BY ALL) f USING (part, entry))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, label, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM kept, range(0, 8) r(part)
        ), book0 AS MATERIALIZED (
            SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
        ), {",".join(steps)}, near7 AS MATERIALIZED ({nearest.format(6)}), coded AS (
            SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near7 GROUP BY ALL
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256
        FROM coded
    """


def _op11_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(URL_RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
        WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        placed AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM placed
    """


ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_url_filter": _op11_sql(),
    "op12_conversation_repair": _op12_sql(),
    "op13_vector_codes": _op13_sql(),
}
