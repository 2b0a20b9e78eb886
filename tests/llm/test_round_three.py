"""URL filters, conversation repair and vector codes against plain versions, their SQL, and odd tables."""

import hashlib
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.llm import conversation_repair, html_extract, queries, url_filter, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_conversation_repair", "op13_vector_codes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


# URL filters


def plain_rule(url, rules, default):
    """Every rule is tried."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.split(".")) if h else 0, len(p), v, h + p) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def test_url_rules_against_all_rules(spark, monkeypatch):
    rng = random.Random(5)
    label, piece = lambda: rng.choice(["a", "b", "com", "ab"]), lambda: rng.choice(["x", "xy", "y", "", "z"])
    host = lambda: ".".join(label() for _ in range(rng.randint(0, 4)))
    path = lambda: "".join("/" + piece() for _ in range(rng.randint(0, 4)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?a=/x', '#/y'])}" for _ in range(400)] + [None, "", "a/b", "http://", "http://A.COM", "http://É.com/x", "http://a.b.com/" + "x/" * 20_000, "x\ny://a.com/x"]
    urls += urls[:3]
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, rule int, host string")
    want = [(i, *plain_rule(u, rules, "block")) for i, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter.judge(pages, rules, "block").collect())) == want
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, url_filter.judge(pages, rules, "block").collect())) == want
    assert sorted(map(tuple, url_filter.judge(pages, rules[:1] * 40, "allow").collect())) == [(i, *plain_rule(u, rules[:1], "allow")) for i, u in enumerate(urls)]


def test_url_rules_on_odd_tables(spark):
    schema = "page_id long, url string"
    assert url_filter.judge(spark.createDataFrame([], schema), [("block", "a", "/")]).count() == 0
    pages = spark.createDataFrame([(None, "http://a/"), (1, "http://a/")], schema)
    rules = [("allow", "a", "/"), ("block", "a", "/"), ("block", None, "/"), ("drop", "a", "/x")]
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str) == [(1, "a", "/", "a/", "block"), (None, "a", "/", "a/", "block")]
    assert [r["verdict"] for r in url_filter.judge(pages, []).collect()] == ["allow", "allow"]


# Conversations


def legal(initials):
    rest = initials[1:] if initials.startswith("s") else initials
    return not initials or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def plain_repair(rows):
    """All edits of a few rows (role, text, fault): the cheapest ones that are legal, then the least in ASCII."""
    best = None
    gaps = ["", "I", "II"]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for kept in itertools.product("KRD", repeat=len(rows)):
            if any(k != "D" and f in ("blank", "duplicate") for k, (_, _, f) in zip(kept, rows, strict=True)):
                continue
            audit = inserts[0] + "".join(k + x for k, x in zip(kept, inserts[1:], strict=True))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for k, (_, _, f) in zip(kept, rows, strict=True) if k != "D" and f == "truncated")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            for roles in itertools.product("ua", repeat=audit.count("R") + audit.count("I")):
                given, at, out = iter(roles), 0, []
                for e in audit:
                    if e == "I":
                        out.append((next(given), ""))
                        continue
                    role, text, _ = rows[at]
                    at += 1
                    if e != "D":
                        out.append((role if e == "K" else next(given), text))
                if all(r[:1] for r, _ in out) and legal("".join(r[:1] for r, _ in out)):
                    names = {"u": "user", "a": "assistant"}
                    best = (cost, audit, "\n".join(f"{names.get(r, r)}:{t}" for r, t in out))
                    break
    return best


def searched(rows):
    edits = []
    search = conversation_repair.Repair(lambda *e: edits.append(e))
    for role, text, fault in rows:
        search.row(role, text, fault if fault == "truncated" else "must go" if fault else "fine")
    cost = search.end()
    return cost, "".join(e[0] for e in edits), "\n".join(f"{e[1]}:{e[2]}" for e in edits if e[0] != "D")


def test_repair_against_all_edits():
    rng = random.Random(3)
    roles, faults = ["user", "assistant", "system", "tool", "ux", ""], [None, None, None, "truncated", "blank", "duplicate"]
    for n in range(200):
        rows = [(rng.choice(roles), f"t{i}", rng.choice(faults)) for i in range(rng.randint(0, 4 if n % 8 else 5))]
        assert searched(rows) == plain_repair(rows), rows


def complete(rows):
    """The same by whole strings: for each state the least (cost, edits)."""
    turn = lambda s: 3 if s == 2 else 2
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def spread(found):
        for s in list(found):
            state, (cost, audit) = s, found[s]
            for _ in range(2):
                state, cost, audit = turn(state), cost + 3, audit + "I"
                found[state] = min(found.get(state, (cost, audit)), (cost, audit))
        return found

    front = spread({0: (0, "")})
    for role, _, fault in rows:
        fresh = {}
        for s, (cost, audit) in front.items():
            left = cost + 3 * (fault == "truncated")
            options = [(s, cost + 4, "D")] + ([] if fault in ("blank", "duplicate") else [(turn(s), left + 3, "R")] + ([(moves[s, role[:1]], left, "K")] if (s, role[:1]) in moves else []))
            for to, c, e in options:
                fresh[to] = min(fresh.get(to, (c, audit + e)), (c, audit + e))
        front = spread(fresh)
    return min(front[s] for s in (0, 3) if s in front)


def test_long_ties_against_whole_strings():
    rng = random.Random(11)
    roles = [["tool"], ["tool", "tool", "user"], ["user", "assistant"], ["system", "user", "assistant", "tool"], ["assistant"]]
    for n in range(300):
        rows = [(rng.choice(roles[n % 5]), "t", rng.choice([None, None, "truncated", "blank"][: 1 + n % 4])) for _ in range(rng.randint(20, 60))]
        assert searched(rows)[:2] == complete(rows), rows


def test_memory_of_a_long_conversation():
    most = given = 0

    def count(*_):
        nonlocal given
        given += 1

    search = conversation_repair.Repair(count)
    for i in range(100_000):
        search.row(("user", "assistant", "tool")[i % 2 if i % 50 else 2], "t.", ("truncated", "must go", "fine")[min(i % 7, 2)])
        most = max(most, len(search.rows))
    assert search.end() > 0 and given >= 100_000 and most < 100
    assert conversation_repair._step.cache_info().currsize < 5000


def test_conversations_on_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, seen int"
    assert conversation_repair.report(spark.createDataFrame([], schema)).count() == 0
    rows = [
        (1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Ho!", 1), (1, None, "system", "Be nice.", 1), (1, 1, "assistant", "Ho!", 1), (1, 5, "assistant", "x" * 1_000_000 + "?", 1),
        (None, None, None, None, None), (None, 0, "user", "a", 1), (2, None, "user", "", 1), (3, 0, "tool", "Ok.\n ", 1),
    ]
    found = {r["conv_id"]: r for r in conversation_repair.report(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for k, r in found.items()} == {
        1: (3, 0, 1, 0, 2, 7, "KKKDIK"), None: (0, 1, 0, 1, 1, 8, "DD"), 2: (0, 1, 0, 0, 0, 4, "D"), 3: (0, 0, 0, 0, 0, 4, "D")
    }
    assert found[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    whole = "system:Be nice.\nuser:Hi.\nassistant:Ho!\nuser:\nassistant:" + "x" * 1_000_000 + "?"
    assert found[1]["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    edits = conversation_repair.repaired(spark.createDataFrame(rows, schema)).where("conv_id = 1").orderBy("place").collect()
    assert "".join(r["edit"] for r in edits) == "KKKDIK"
    assert "\n".join(f"{r['role']}:{r['text']}" for r in edits if r["edit"] != "D") == whole
    # every row is taken away: the conversation stays
    gone = conversation_repair.report(conversation_repair.damaged(spark.createDataFrame(rows, schema), lot=F.lit(0)))
    assert sorted({tuple(r)[1:9] for r in gone.collect()}) == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] and gone.count() == 4


# Vectors


def plain_codes(vectors, positions, entries, rounds):
    rows = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in vectors]
    step = len(rows[0][1]) // positions
    part = lambda v, j: v[j * step : (j + 1) * step]
    books = [[part(v, j) for _, v, _ in sorted(rows, key=lambda r: r[0])[:entries]] for j in range(positions)]
    best = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for j, book in enumerate(books):
            own = [[] for _ in book]
            for _, v, _ in rows:
                own[best(part(v, j), book)[1]].append(part(v, j))
            books[j] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, book, strict=True)]
    out = []
    for i, v, label in rows:
        found = [best(part(v, j), books[j]) for j in range(positions)]
        out.append((i, [n for _, n in found], sum(d for d, _ in found), label))
    return out, books


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e5, 1e6])
def test_codes_against_all_distances(spark, scale):
    rng = random.Random(7)
    single = lambda x: __import__("numpy").float32(x).item()
    vectors = [(i, [single(round(rng.gauss(0, 1), 1) * scale) for _ in range(8)], i % 3 if i % 4 else None) for i in range(300)]
    vectors += [(1000 + i, v, 9) for i, v, _ in vectors[:40]]
    bad = [(-1, None, 1), (-2, [1.0] * 7 + [None], 1), (-3, [1.0] * 7 + [float("nan")], 1), (-4, [1.0] * 7 + [float("-inf")], 1), (5000, [1.0] * 6, 1), (5001, [], 1)]
    table = spark.createDataFrame([(*v, "x") for v in vectors + bad], "vec_id long, embedding array<float>, label int, error string").repartition(5)
    coded, books = vector_codes.compress(table, positions=4, entries=6, rounds=3)
    want, want_books = plain_codes(vectors, 4, 6, 3)
    long = lambda x: x if x < 1 << 63 else None
    sums, held = {}, {}
    for _, _, error, label in want:
        sums[label], held[label] = sums.get(label, 0) + error, held.get(label, True) and long(error) is not None
    got = sorted((tuple(r) for r in coded.select("vec_id", "codes", "error", "label", "label_error").collect()), key=lambda r: r[0])
    assert books == want_books and got == [(*r[:2], long(r[2]), r[3], long(sums[r[3]]) if held[r[3]] else None) for r in want]


def test_pivots_spare_distances():
    import numpy as np

    rng = np.random.default_rng(1)
    parts = rng.integers(-9000, 9000, (2000, 2, 4)) + rng.integers(0, 3, (2000, 1, 1)) * 100_000
    books = parts[:16].transpose(1, 0, 2).tolist()
    pivots = [vector_codes.chosen_pivots(b) for b in books]
    codes, errors, evaluated = vector_codes.nearest(parts, vector_codes.pivot_distances(parts, pivots), books, pivots)
    for j in range(2):
        all_ = ((parts[:, j, None] - np.array(books[j])[None]) ** 2).sum(-1)
        assert (codes[:, j] == all_.argmin(1)).all() and (errors[:, j] == all_.min(1)).all()
    assert evaluated < 0.4 * 2000 * 2 * 16


def test_codes_on_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert coded.count() == 0 and books == [[]] * 8
    coded, books = vector_codes.compress(spark.createDataFrame([(None, [1.0] * 8, None), (1, [0.5] * 8, None), (1, [0.5] * 8, 2)], schema))
    assert sorted(((r["vec_id"], r["error"], r["label_error"]) for r in coded.collect()), key=str) == [(1, 0, 0), (1, 0, 0), (None, 0, 0)]
    huge, books = vector_codes.compress(spark.createDataFrame([(0, [3e38] * 8, 1), (1, [-3e38] * 8, 1)], schema), entries=1)
    assert [r["error"] for r in huge.collect()] == [None, None] and all(e[0][0] == 0 or abs(e[0][0]) < 1e36 for e in books)


# HTML

BROKEN = (
    "<p ", '<a href="x ', "<![CDATA[ ", "<!-- ", "<!", "< ", "<script>a</script ", '<a ">" ', "<a '>\" ", "<a<", '<p a="b c=', "<div></p>", "<li><div>", "<dl><dd><div>", "<ul><li><div><div>", "<head>", "<svg>",
    "<button>", "<h2>Comments</h2><p>x", "<article><h1>x", "&#11111", "&#0000",
)


@pytest.mark.parametrize("form", BROKEN)
@pytest.mark.parametrize("tail", ["", "'", '">'])
def test_broken_markup_takes_linear_time(form, tail):
    import time

    took = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        html_extract.main_text(form * (size // len(form)) + tail)
        took.append(time.process_time() - began)
    assert took[1] < 4 and took[1] < 40 * max(took[0], 0.05)


def test_many_different_siblings_take_linear_time():
    import time

    labels = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)]
    page = html_extract.Page("".join(f'<div class="c{x}">x</div>' for x in labels))
    skeleton = page.skeleton()[0]
    began = time.process_time()
    assert len(html_extract.align(skeleton, skeleton + "\n1 p")) == len(labels) + 1 and time.process_time() - began < 3


def plain_matching(one, other):
    """The size of a largest matching of two trees of (label, children) by the textbook recursion over all pairs of children."""
    if one[0] != other[0]:
        return 0
    best = [[0] * (len(other[1]) + 1) for _ in range(len(one[1]) + 1)]
    for i, a in enumerate(one[1], 1):
        for j, b in enumerate(other[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(a, b))
    return best[-1][-1] + 1


def test_tree_matching_against_all_pairs():
    rng = random.Random(2)

    def tree(depth):
        labels = rng.sample("abcdef", rng.randint(0, 5) if depth else 0)
        return [(x, tree(depth - 1)) for x in labels]

    def lines(node, depth=0):
        return [f"{depth} {node[0]}", *(x for c in node[1] for x in lines(c, depth + 1))]

    for _ in range(200):
        one, other = ("#", tree(3)), ("#", tree(3))
        found = html_extract.align("\n".join(lines(one)), "\n".join(lines(other)))
        assert len(found) == plain_matching(one, other)
        kept = sorted(found)
        assert [found[i] for i in kept] == sorted(found.values())


def test_headers_buttons_and_readers_comments():
    around = "<body><header><p>Site</p></header><main>{}</main>"
    for page in (
        "<article><header><h1>Title</h1><p>Lead</p></header><p>Body</p></article>", "<article><header><h3>Title</h3></header><p>Lead</p><p>Body</p></article>",
        "<article><p>Title</p></article><article><h2>Lead</h2><p>Body</p></article>", '<h1>Title</h1><p>Lead</p><p>Body</p><div class="reader-comments"><p>c</p></div>', '<h1>Title</h1><p>Lead</p><p>Body</p><div id="user-reviews"><p>c</p></div>',
        "<h1>Title</h1><p>Lead</p><p>Body</p><h2>Comments</h2><ul><li>c<li>d</ul>", "<h1>Title</h1><p>Lead</p><section><h2>3 comments</h2><p>c</p><h3>Anna</h3><p>d</p></section><p>Body</p>",
        "<h1>Title</h1><p>Lead</p><label>Email</label><button>Subscribe</button><p>Body</p>", "<h1>Title</h1><h2>Comments (2)</h2><p>c</p><h2>Lead</h2><p>Body</p>",
    ):
        assert html_extract.main_text(around.replace("{}", page)) == "Title\nLead\nBody", page
    assert html_extract.main_text("<main><p>one<button>x</button>two</p></main>") == "one two"
    assert html_extract.main_text("<p>&#" + "1" * 5000 + "; &#" + "0" * 5000 + "65; &#x41;</p>") == "\ufffd A A"


def test_wrappers_of_undeclared_pages_against_plain_counts(spark):
    """Pages without article or main: what at least three different pages and 60 % of a host's pages say in the same place goes, the rest stays."""
    rng = random.Random(9)
    rows, blocks = [], {}
    for host, n in (("a", 40), ("b", 7), ("c", 4), ("d", 2), ("e", 1)):
        for i in range(n):
            top, end = f"Top of {host}", f"{host} {'common' if rng.random() < 0.9 else f'rare {i}'} end"
            own = [f"{host} {i} says {k}" for k in range(rng.randint(1, 5))] + (["Quoted by few"] if i % 4 == 0 else [])
            blocks[len(rows)] = host, (top, *own, end)
            html = f"<html><body><div class=one>{top}</div><div class=two>{''.join(f'<p>{x}</p>' for x in own)}</div><div class=three>{end}</div></body></html>"
            rows.append((len(rows), f"http://{host}.example/{i}", html))
    rows += [(1000 + i, u, h) for i, u, h in rows[:5]]  # copies count once
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    sizes, said = {}, {}
    for host, texts in blocks.values():
        sizes[host] = sizes.get(host, 0) + 1
        for place, text in enumerate(("top", *["own"] * (len(texts) - 2), "end")):
            said.setdefault((host, text, texts[place]), []).append(1)
    for i, (host, texts) in blocks.items():
        places = ("top", *["own"] * (len(texts) - 2), "end")
        kept = [t for p, t in zip(places, texts, strict=True) if len(said[host, p, t]) < max(3, 0.6 * sizes[host])]
        assert got[i] == "\n".join(kept), (host, i)
    assert all(got[1000 + i] == got[i] for i in range(5))
    assert spark.createDataFrame(rows, "page_id long, url string, html string").count() == len(got)


def test_html_on_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, text string, n_chars int"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, "t", 1), (1, "http://a/", "", "h", None, None), (1, "http://a/", "<p>x</p>", "h", None, None), (2, "http://a/", "<p " * 300_000, "h", None, 1), (3, None, "y" * 3_000_000, "", "", 1)]
    got = sorted((tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, schema)).select("page_id", "n_chars").collect()), key=str)
    assert got == [(1, 0), (1, 1), (2, 899_999), (3, 3_000_000), (None, 0)]
