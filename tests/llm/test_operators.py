import hashlib
import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from veilspark.llm import common, exact_dedup, graph, html_extract, language_id, near_dedup, packing, pii, quality, queries, sentence_pieces, sharding, token_counts, tokens

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
ODD = [
    (1, "a b c d e f", "en", "s", 1),
    (1, "a b c d e f", "en", "s", 1),
    (2, "A b C d e f", None, "s", 2),
    (None, None, "en", None, None),
    (None, "a b c d e f", None, None, None),
    (4, "", "de", "s", 0),
    (5, " \t\n\x0b ", "de", "s", 3),
    (6, LONG, "en", "s", 4),
    (7, "één x@y.example.org 4111 1111 1111 1111 +1 (743) 555-3824 10.0.0.1 😀", "fr", "s", 5),
    (8, "…" * 40 + "\x00 end <|endoftext|>", "fr", "s", 6),
]
CLASH = ["_spans", "a.b", "_hot", "kept", "size", "shard", "slot", "n_words", "spans", "_row", "digest", "component", "bucket", "stratum", "part", "piece", "key", "node", "cid"]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "exact": lambda s, d: exact_dedup.exact_groups(d, F.col("doc_id") % 2 == 0),
    "near": lambda s, d: near_dedup.near_groups(d, 2, 80),
    "pii": lambda s, d: pii.report(d),
    "redact": lambda s, d: pii.redact(d),
    "packing": lambda s, d: packing.pack_documents(d, queries.BPE),
    "sharding": lambda s, d: sharding.assign_shards(d, 16),
    "counts": lambda s, d: token_counts.count_tokens(d, queries.BPE, "v"),
    "pieces": lambda s, d: sentence_pieces.round_trip(d, queries.PIECES),
    "language": lambda s, d: language_id.identify(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(spark, odd, name):
    rows = RUNS[name](spark, odd).collect()
    assert len({str(r) for r in rows}) > 0
    assert len(rows) >= len(ODD)
    assert RUNS[name](spark, odd.limit(0)).count() == 0


def test_quality_features(spark, odd, docs, texts):
    for r in quality.features(docs).collect():
        assert {k: r[k] for k in brute.features("")} == brute.features(texts[r.doc_id])
    for r, (_, text, *_) in zip(quality.features(odd.coalesce(1), keep=("text",)).collect(), ODD, strict=True):
        assert {k: r[k] for k in brute.features("")} == brute.features(text)


def test_quality_bounds(spark):
    """The native tail agrees with the plain sum, and a bad signal is rejected in the stratum that can certify it."""
    for n, p, level in ((50, 0.02, 0.004), (400, 0.02, 0.004), (3000, 0.02, 0.001), (10, 0.5, 0.05), (900_000, 0.02, 0.01)):
        got = spark.range(1).select(quality.most_rejected(F.lit(float(n)), p, F.lit(level)).alias("k")).first().k
        if n < 10_000:
            tail, k = 0.0, -1
            for i in range(n):
                tail += math.comb(n, i) * p**i * (1 - p) ** (n - i)
                if tail > level:
                    break
                k = i
            assert got == k
        else:
            assert abs(got - (n * p - 2.326 * math.sqrt(n * p * (1 - p)))) < 5
    good, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}***" for i in range(60))
    rows = [(i, good if i % 4 else bad, "en") for i in range(1200)] + [(2000 + i, bad, "xx") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = df.select("doc_id", (~F.contains("text", F.lit("*"))).cast("int").alias("quality"))
    verdict = {(r.lang, r.n_symbols > 0): r.kept for r in quality.judge(df, marks, keep=("doc_id", "lang")).collect()}
    assert verdict == {("en", False): True, ("en", True): False, ("xx", True): True}


def test_exact(spark, odd, docs, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for history in (F.lit(True), F.lit(False), F.col("doc_id") % 3 == 0):
        for r in exact_dedup.exact_groups(docs, history).collect():
            g = groups[texts[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    rows = exact_dedup.exact_groups(odd, F.col("doc_id") % 2 == 0).collect()
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256 for r in rows})


def test_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash.build(keys[:4000])
    assert sorted(mph.slots(keys[:4000])) == list(range(4000))
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("width", [2, 5])
def test_near(spark, docs, texts, width):
    want = brute.near(texts.items(), width, 80)
    for r in near_dedup.near_groups(docs, width, 80).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_hot_group(spark, monkeypatch):
    """Nodes far over the limit: chunks, pivots, free sets and blocks still give the brute-force components."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.choice(120, 4, replace=False):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:30] + [f"y{i}_{k}" for k in range(60)])) for i in range(300)]
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 100)
    want = brute.near(rows, 2, 80)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert Counter(r.component_id for r in got if r.stays) == Counter({c for _, c in want.values()})


def test_components_without_a_fixed_point_are_an_error(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), rounds=1)


def test_join_counted(spark):
    """Hot keys, missing keys and rare ones give what a plain left join gives."""
    rows = spark.createDataFrame([(1 if i % 3 else None if i % 2 else i, i) for i in range(6000)], "k long, v long")
    named = rows.where("k % 4 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    plain = rows.join(named, "k", "left")
    got = common.join_counted(rows, named, "k", "n")
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_components_around_a_hub(spark):
    """A hub with most of the edges, chains of it and pairs apart: hubs are joined by a shuffle as the rest is."""
    edges = [(5000, i) for i in range(5001, 8000)] + [(i, i + 20000) for i in range(5001, 5040)] + [(40000 + 2 * i, 40001 + 2 * i) for i in range(1500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 5000 if x < 40000 else x - x % 2 for e in edges for x in e}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100}


def test_pii(spark, odd, docs, texts):
    for rows, text_of in ((pii.report(docs).collect(), texts),):
        for r in rows:
            want = brute.personal(text_of[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    hard = ["1.2.3.4.5.6.7.8 300.1.1.1 1.2.3", "a@b.com_x@d.com a@b a@b..c @x.y .@-.-", "4111-1111 1111  1111 41111111111111112222 4111 1111 1111 1111-", "+1--2 +12345678 ++4 (4) 44444444 +1 234 567 8901 23456789", "1" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    assert {r.doc_id: r.base_sha256 for r in pii.report(df).collect()} == {i: hashlib.sha256(brute.personal(t).encode()).hexdigest() for i, t in enumerate(hard)}


def test_pii_bootstrapping(spark):
    """Values behind words that announce valid cards are found though their checksum fails; elsewhere they are not."""
    cards = []
    for i in range(40):
        stem = f"4{i:014d}"
        cards.append(next(stem + c for c in "0123456789" if brute.luhn(stem + c)))
    wrong = cards[0][:-1] + str((int(cards[0][-1]) + 1) % 10)
    rows = [(i, f"note {i} card number {c} paid") for i, c in enumerate(cards)] + [(100, f"the card number {wrong} failed"), (101, f"ticket reference {wrong} open")]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "card:16:32" and spans[101] == ""
    # words on the right, after a line end, and far more than 64 characters from the last match
    right = [(i, f"{'pad ' * 40}x{i}\t{c} debited\nfrom the account") for i, c in enumerate(cards)] + [(100, f"we say no{chr(10)}{wrong}  Debited"), (101, f"{wrong} dollars")]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(right, "doc_id long, text string")).collect()}
    assert spans[100] == "card:10:26" and spans[101] == ""
    clean = pii.redact(spark.createDataFrame([(1, "x a@b.com y 10.0.0.1", "k"), (2, None, "k")], "doc_id long, text string, kept string")).collect()
    assert sorted((r.doc_id, r.text, r.kept) for r in clean) == [(1, "x [EMAIL] y [IP]", "k"), (2, None, "k")]


def test_pii_graph_scores(spark):
    """Trusted patterns against a plain version of the graph, where trust takes more than one round to spread."""
    rng = np.random.default_rng(3)
    edges = {(int(p), int(i)) for p, i in zip(rng.integers(0, 40, 3000), rng.integers(0, 1200, 3000), strict=True)}
    edges |= {(100, 5000 + i) for i in range(400)} | {(p, 6000 + i) for p in (100, 101) for i in range(40)} | {(101, 7000), (101, 7001), (102, 7000)}
    seed = {i for _, i in edges if (i < 1100 and i % 20) or 5000 <= i < 6000}
    rows = [(0, i, 0, 1, i in seed, str(i), [p]) for p, i in edges]
    found = spark.createDataFrame(rows, "_n long, kind int, start long, end long, base boolean, value string, patterns array<long>")
    by, trust = defaultdict(set), {i: 1.0 for i in seed}
    for p, i in edges:
        by[p].add(i)
    for _ in range(200):
        share = {p: sum(trust.get(i, 0.0) for i in x) / (len(x) + pii.SMOOTH) for p, x in by.items()}
        sure = {p for p, v in share.items() if v >= pii.CONFIDENT and sum(trust.get(i, 0.0) >= pii.CONFIDENT for i in by[p]) >= pii.SUPPORT}
        trust = {i: 1.0 for i in seed}
        for p in sure:
            for i in by[p]:
                trust[i] = max(trust.get(i, 0.0), share[p])
    assert {r.pattern for r in pii.confident_patterns(found).collect()} == sure and {100, 101} <= sure and 102 not in sure


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.BPE)
    ids = {i: np.array([*slow.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    rows = packing.pack_documents(docs, queries.BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(len(x) for x in ids.values())
    assert len(by_sequence) * 2048 - used < 0.03 * used


def test_first_fit_decreasing():
    lengths = np.random.default_rng(2).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if at is None:
            at = len(room)
            room.append(100)
        want[i] = (at, 100 - room[at])
        room[at] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in want} == want


def test_byte_bpe():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(queries.BPE), tokens.byte_bpe(queries.BPE)
    hard = [t or "" for _, t, *_ in ODD] + ["I'll we've\t\t x  y \x85 \x1c á ǅ Ⅷ ² ½ 日本語 <|endoftext|>", "  lead\n\n trail  ", "".join(map(chr, range(32, 0x250)))] + [f" a{chr(i)} {chr(i)}b{chr(i)}{chr(i)} 1" for i in range(1, 0x2100)]
    assert all(fast(t) == slow.encode(t, add_special_tokens=False).ids for t in hard)


def test_sharding(spark, docs, texts):
    rows = sharding.assign_shards(docs, 16).collect()
    by_shard = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "key", brute.jump(r.doc_id, 16), brute.jump(r.doc_id, 17))
        assert r.grown_shard in (r.shard, 16)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_rollup(spark, tmp_path, odd):
    counts = token_counts.count_tokens(odd, queries.BPE, "1")
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.apply("a", token_counts.inserts(counts)) and not rollup.apply("a", token_counts.inserts(counts))
    total = sum(r.n_tokens for r in counts.collect())
    assert sum(r.n_tokens for r in rollup.totals().collect()) == total and sum(r.n_docs for r in rollup.totals().collect()) == len(ODD)
    moved = counts.where("lang = 'fr'")
    assert rollup.apply("b", token_counts.revisions(moved, moved.withColumn("tokenizer_version", F.lit("2"))))
    assert not [r for r in rollup.totals().collect() if r.lang == "fr" and r.tokenizer_version == "1"]
    assert rollup.apply("c", token_counts.deletes(counts.where("lang = 'en'")))
    assert not [r for r in rollup.totals().collect() if r.lang == "en"]


def test_rollup_rivals_folds_and_no_batches(spark, tmp_path, monkeypatch):
    """Two committers past the check: one wins, nothing is left of the other; snapshots change no totals; no batch, no rows."""
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0 and rollup.fold() and rollup.totals().count() == 0
    rows = lambda n: spark.createDataFrame([("s", None, "1", n, 10 * n, 100 * n)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long")
    monkeypatch.setattr(token_counts.Rollup, "committed", lambda self, batch_id: False)
    assert rollup.apply("a", rows(1)) and not rollup.apply("a", rows(5)) and rollup.apply("b", rows(2))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", None, "1", 3, 30, 300)]
    assert rollup.fold() and rollup.apply("c", rows(-1)) and [r.n_docs for r in rollup.totals().collect()] == [2]
    assert sorted(x.name for x in (tmp_path / "rollup").iterdir()) == ["_staged", "batch=a", "batch=b", "batch=c", "snapshot=00000000", "snapshot=00000001"]
    assert not list((tmp_path / "rollup/_staged").iterdir()) and not list((tmp_path / "rollup/batch=a").glob("batch*"))
    assert rollup.apply("d", rows(-2)) and rollup.totals().count() == 0


def test_token_count_query(spark, docs, texts):
    """The registered query against plain counts: languages other than English end under the second version."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.BPE)
    want = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        key = (r.source, r.lang, f"byte_bpe_50k/{1 if r.lang == 'en' else 2}")
        for k, v in enumerate((1, len(slow.encode(r.text, add_special_tokens=False).ids), len(r.text.encode()))):
            want[key][k] += v
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens, r.n_bytes] for r in queries.op5_token_counts(spark, SF).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("left_out", ["0002", "0003", "0004"])
def test_token_count_query_needs_every_batch(spark, monkeypatch, left_out):
    """Revisions and deletes move documents that have text: without one of them the totals of tokens are others."""

    def tokens():
        return sum(r.n_tokens for r in queries.op5_token_counts(spark, SF).collect())

    whole, apply = tokens(), token_counts.Rollup.apply
    monkeypatch.setattr(token_counts.Rollup, "apply", lambda self, batch_id, changes: batch_id != left_out and apply(self, batch_id, changes))
    assert (tokens() - whole) * (-1 if left_out == "0004" else 1) > 0


def test_sentence_pieces(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    model = sentence_pieces.pieces(queries.PIECES)
    hard = [t or "" for _, t, *_ in ODD] + ["  Hello   world\n\nfoo\tbar ", "⁇ é😀 <s>", "a" * 500, " ", "日本語テキスト" * 20, "aaa aaaa aaaaa"] + list(texts.values())
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(hard)] == [sp.encode(t) for t in hard]
    assert [model.decode(x) for x in model.encode(hard)] == hard


def test_unigram_viterbi():
    vocab = {"▁a": -2.0, "▁ab": -2.5, "b": -1.0, "bc": -1.2, "c": -3.0, "▁": -4.0, "a": -1.5, "abc": -2.0}
    model = sentence_pieces.Pieces(["<unk>", *vocab], [0.0, *vocab.values()], {}, 0, [False] + [True] * len(vocab), bpe=False)

    def best(word):
        paths = [(0.0, [])] + [None] * len(word)
        for j in range(1, len(word) + 1):
            options = []
            for i in range(j):
                piece = word[i:j]
                if paths[i] and (piece in vocab or j - i == 1):
                    options.append((paths[i][0] + vocab.get(piece, model.unknown_score), paths[i][1] + [model.vocab.get(piece, 0)]))
            paths[j] = max(options, key=lambda x: x[0]) if options else None
        return paths[-1][1]

    words = [f"▁{a}{b}{c}{d}" for a in "abcx" for b in "abc" for c in "abc" for d in "ab"]
    assert model._together(words) == [best(w) for w in words] == [model._alone(w) for w in words]


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !?", "en"), (3, "the and of", None), (4, "", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()}[2] == "und"


def test_language_filter_returns_all_languages():
    gram = np.arange(1000, dtype=np.int64)
    model = language_id.LanguageFilter(["a", "b"], 0, 1000)
    model.add(np.r_[np.zeros(1000, int), np.ones(500, int)], np.r_[gram, gram[:500]])
    masks = model.masks(gram)[:, 0]
    assert (masks[:500] == 3).all() and (masks[500:] & 1 == 1).all() and (masks[500:] & 2 > 0).mean() < 0.01


def test_language_filter_holds_flat_scripts(spark):
    """Two dense languages with over 100,000 grams do not push out a third whose grams are all rare."""
    rng = np.random.default_rng(1)

    def text(first, n):
        return "".join(map(chr, rng.integers(first, first + 2000, n)))

    dense, other, flat = text(0x4E00, 60_000), text(0xAC00, 60_000), text(0x6000, 150_000)
    model = language_id.train(spark.createDataFrame([(dense, "a")] * 4 + [(other, "b"), (flat, "c")], "text string, lang string"))
    langs, scores = model.decide([dense[:300], other[:300], flat[:300], flat[-300:]])
    assert langs == ["a", "b", "c", "c"] and (scores > 0.9).all() and (model.false_rate < 0.05).all()


def test_language_filter_and_decisions_against_plain_sets(spark):
    """Each language's slices hold all its grams and its typical ones; the filter only adds false positives, which are few."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 < 3")
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").collect()
    count = defaultdict(Counter)
    for r in rows:
        count[r.lang].update(language_id.grams([r.text.replace("\n", " ")])[1].tolist())
    bound = {}
    for lang, c in count.items():
        left = language_id.TAIL * sum(c.values())
        for n, mass in sorted(Counter({n: n * k for n, k in Counter(c.values()).items()}).items()):
            bound[lang], left = n, left - mass
            if left < 0:
                break
    assert language_id.typical(language_id.count_grams(docs)) == bound
    model = language_id.train(docs)
    sets = [set(count[lang]) for lang in model.langs] + [{g for g, n in count[lang].items() if n >= bound[lang]} for lang in model.langs]
    known = set().union(*sets)
    probes = np.fromiter(known | {g + 7 for g in known}, np.int64)
    masks = model.masks(probes)[:, 0]
    for i, held in enumerate(sets):
        hit, member = (masks >> i) & 1 > 0, np.isin(probes, np.fromiter(held, np.int64))
        assert hit[member].all() and hit[~member].mean() < 0.01
    texts, k = [r.text for r in rows[:200]], len(model.langs)
    for text, lang in zip(texts, model.decide([t.replace("\n", " ") for t in texts])[0], strict=True):
        grams = language_id.grams([text.replace("\n", " ")])[1].tolist()
        share = {x: sum((g in sets[i]) + (g in sets[i + k]) for g in grams) / max(1, 2 * len(grams)) for i, x in enumerate(model.langs)}
        assert not grams or share[lang] >= max(share.values()) - 0.01


def test_language_filter_within_its_bytes(spark, monkeypatch):
    """A filter too large to send has fewer positions: every gram stays in it, and counts are corrected for the false positives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    monkeypatch.setattr(language_id, "FILTER_BYTES", 1 << 14)
    model = language_id.train(docs)
    assert model.table.nbytes == 1 << 14 and 0.01 < model.false_rate.max() < 0.9
    rows = docs.select("text", "lang").collect()
    gram = language_id.grams([rows[0].text.replace("\n", " ")])[1]
    assert (model.masks(gram)[:, 0] >> model.langs.index(rows[0].lang) & 1 == 1).all()
    said = model.decide([r.text.replace("\n", " ") for r in rows])[0]
    assert sum(x == r.lang for x, r in zip(said, rows, strict=True)) > 0.97 * len(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First   para<br>goes&nbsp;on<p><b>Second <i>one</b></i><aside>Related</aside><div class="ad">Buy</div>
<form><p>Search</p></form><p hidden>no</p><pre>code  x</pre><section class="comments"><p>Nice post</p></section></article><footer>&copy; Site</footer>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Title & more\nFirst para goes on\nSecond one\ncode x"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("a < b <p") == "a < b <p"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    rows = [(i, f"http://h.example/{i}", f"<html><body><div class=x1>Same top</div><div class=x2><p>Own text {i}</p><p>More of {i}</p></div><div class=x3>Same end</div></body></html>") for i in range(8)]
    rows += [(100, None, None), (101, "not a url", "<p>alone</p>"), (101, "not a url", "<p>alone</p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own text {i}\nMore of {i}" for i in range(8)} | {100: "", 101: "alone"} and len(got) == len(rows)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_in_declared_articles(spark, monkeypatch):
    """The wrapper decides inside declared articles too: rows change when it is removed. Articles that are copies stay whole."""
    page = "<html><body><nav>Menu</nav><article><h1>News {i}</h1><p>Own text {i}</p><div>Sign up for our letters</div></article><footer>End</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(8)] + [(i, f"http://copy.example/{i}", page.format(i=0)) for i in range(10, 16)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {i: f"News {i}\nOwn text {i}" for i in range(8)} | {i: "News 0\nOwn text 0\nSign up for our letters" for i in range(10, 16)}
    induce = html_extract.induce
    monkeypatch.setattr(html_extract, "induce", lambda pages: induce(pages).where("false"))
    bare = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(bare[i] == f"News {i}\nOwn text {i}\nSign up for our letters" for i in range(8))


def test_html_names_do_not_exclude_the_article():
    article = "<article><h1>Title</h1><p>Body</p></article>"
    for around in (
        '<body class="has-sidebar">{}', '<html class="cookie modal"><body class="menu">{}', '<main class="no-sidebar"><h1>Title</h1><p>Body</p></main>', '<article class="post comments-open"><h1>Title</h1><p>Body</p></article>',
        '<article class="post sponsored"><h1>Title</h1><p>Body</p></article>', '<div class="with-menu">{}</div>', '<div class="overlay"><div class="widget">{}</div></div>', '<body class="page-header has-header">{}',
        '<div class="widget">{}</div><div class="sidebar"><p>Aside</p></div>', '<article class="related"><p>Teaser</p></article>{}', '<div class="related"><article>Teaser</article></div>{}',
    ):
        assert html_extract.main_text(around.replace("{}", article)) == "Title\nBody", around
    for other in ("site-nav", "cookie-notice", "post-comments", "ad", "ad-slot-3", "x related-posts"):
        assert html_extract.main_text(f'<div class="{other}"><p>Other</p></div><div><p>Body</p></div>') == "Body", other
    assert html_extract.main_text('<div hidden><article>Not shown</article></div><p>Body</p>') == "Body"


def test_html_article_among_comments_menus_and_scripts():
    for page in (
        '<article><h1>Title</h1><p class="social-science">Body</p></article>', '<article><h1>Title</h1><div class="share-price-report">Body</div></article>',
        "<article><h1>Title</h1><p>Body</p></article><article><p>Nice post</p></article>", "<article><h1>Title</h1><p>Body</p><article><p>me too</p></article></article>",
        "<main><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><h1>Title</h1><p>Body</p></main>", "<article><h1>Title</h1><script src=//c.d/x/>code</script><p>Body</p></article>",
    ):
        assert html_extract.main_text(page) == "Title\nBody", page
    assert html_extract.main_text("<article><h2>A</h2><p>a</p></article><article><h2>B</h2><p>b</p></article>") == "A\na\nB\nb"
    assert html_extract.main_text("<article><article><p>inner</p></article></article>") == "inner"


def test_html_wrappers_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<html><body><p>Top {i % 3}</p><p>Own {i}</p></body></html>") for i in range(30)] + [(99, None, "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "maybe_broadcast", lambda df: df)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {i: f"Own {i}" for i in range(30)} | {99: "alone"}


def test_html_template_beside_content_and_in_a_second_layout(spark):
    """A notice among paragraphs of its own label goes, so does the template of 40 % of a host's pages; few copies make no template."""
    first = "<html><body class='post-{w}'><div><p>Cookies are used here</p><p>Own text {i}</p><p>More of {i}</p><p>All rights reserved</p></div></body></html>"
    second = "<html><body><table><tr><td>Top of layout two</td></tr></table><section><div class=entry><p>Text {i}</p><p>Write to us</p></div><h4>End of layout two</h4></section></body></html>"
    copy = "<html><body><section><blockquote><p>Copied one</p><h3>Copied two</h3></blockquote></section></body></html>"
    rows = [(i, first.format(i=i, w="abcdefghijkl"[i])) for i in range(12)] + [(i, second.format(i=i)) for i in range(20, 28)] + [(i, copy) for i in range(30, 36)]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in rows], "page_id long, url string, html string")
    want = {i: f"Own text {i}\nMore of {i}" for i in range(12)} | {i: f"Text {i}" for i in range(20, 28)} | {i: "Copied one\nCopied two" for i in range(30, 36)}
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def test_tree_matching():
    one = "0 #\n1 body\n2 nav\n2 div\n3 p\n2 footer"
    other = "0 #\n1 body\n2 div\n3 p\n3 table\n2 aside\n2 footer"
    assert html_extract.align(one, other) == {0: 0, 1: 1, 3: 2, 4: 3, 5: 6}
    assert html_extract.align(one, one) == {i: i for i in range(6)}


def test_pages_against_markup(spark):
    import html as htmllib
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(htmllib.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_pipeline(spark, texts):
    """Each stage against plain rules, on what the stage before it kept."""
    import re

    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, dict(texts)
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        now = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality rules":
            assert set(now) <= {i for i, t in kept.items() if not brute.features(t)["base_failed"]} and len(now) > 0.7 * len(kept)
        elif name == "exact deduplication":
            assert set(now) == {max(i for i in kept if kept[i] == t) for t in set(kept.values())}
        elif name == "near deduplication":
            assert set(now) == {c for _, c in brute.near(kept.items(), 5, 80).values()}
        else:
            assert set(now) == set(kept) and not any(brute.personal(t) for t in now.values())
            assert sum(len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", t)) for t in now.values()) >= sum(bool(brute.personal(t)) for t in kept.values())
        kept = now
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()} == set(kept)


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_on_odd_tables(spark, odd, number):
    """Nulls, repeats, ties, long texts and clashing columns: what a stage keeps is whole rows of its input, and no row is invented."""
    import corpus_pipeline as pipeline

    name, stage = pipeline.STAGES[number]
    rows = stage(spark, odd, SF).collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    given = Counter(map(str, odd.collect()))
    if number == 4:
        assert Counter(r.doc_id for r in rows) >= Counter(r.doc_id for r in odd.collect())
    elif number == 3:
        assert len(rows) == len(ODD) and {r["a.b"] for r in rows} == {"clash"} and sum(r.text is None for r in rows) == 1
        assert any("[CARD]" in (r.text or "") and "[EMAIL]" in r.text for r in rows)
    else:
        assert not Counter(map(str, rows)) - given
        kept = Counter(r.text for r in rows)
        if number == 0:
            assert set(kept) <= {LONG}
        elif number == 1:
            assert set(kept) == {t or "" if t else t for _, t, *_ in ODD if t} | {"" if "" in kept else None} and max(kept.values()) == 1
        else:
            assert len(rows) == 6 + 1 and kept[None] == kept[""] == 1
