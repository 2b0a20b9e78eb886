"""Personal data: fixed base patterns, then bootstrapped contextual extraction. DataFrame expressions only.

Bootstrapping: the base matches are seeds. The words beside a match make lexical patterns of four kinds: the two words on its left, the
one on its left, the one on its right, and one on each side. Matches and look-alikes that fail the base rules are instances; a
pattern and an instance that occur together are an edge of a bipartite graph. Scores travel over it until they rest: a pattern's
confidence is the smoothed share of its distinct instances that are trusted, an instance's trust is that of its best confident pattern,
seeds stay at 1. Scores only rise, and are at most 1, so they come to rest. Patterns that end up confident and well supported mark
their remaining look-alikes as identifiers of the same kind.

Positions come from splitting a text by a regular expression: pieces and matches alternate, so a running sum of their lengths
gives the offsets in code points. Only matches leave the text's row; the sums run over them by (row, expression).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, durable, keyed, maybe_broadcast, numbered

KINDS = ("email", "ip", "card", "phone")

#: Base patterns, written so that no position is tried twice and nothing backtracks over a long run; each finds the same
#: matches as the plain form: a match can only begin where a run begins or where the last match ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Look-alikes: mail addresses in other writings, longer dotted numbers, and any longer number.
_LIKE_EMAIL = r"(?<![^ \t-\r])[^ \t-\r@]++@[^ \t-\r@]++(?![^ \t-\r])"
_LIKE_IP = r"(?<![0-9.:])[0-9]++(?:[.:][0-9]++){3,7}+(?![.:]?[0-9])"
_LIKE_NUMBER = r"(?<![0-9])(?<![0-9][ .()-])[0-9](?:[ .()-]{0,2}+[0-9]){6,18}+(?![ .()-]?[0-9])"

#: (expression, kind, base, character a text must hold for it, None for any)
_SCANS = (
    (_EMAIL, 0, True, "@"),
    (_IP, 1, True, "."),
    (_CARD, 2, True, None),
    (_PHONE, 3, True, "+"),
    (_LIKE_EMAIL, 0, False, "@"),
    (_LIKE_IP, 1, False, None),
    (_LIKE_NUMBER, 2, False, None),
)

#: Confidence that a pattern needs, distinct trusted instances that must support it, the smoothing of shares, and the change of the
#: scores' sum below which they rest.
CONFIDENT, SUPPORT, SMOOTH, RESTS = 0.8, 5, 1.0, 1e-6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    """The base checks that a match must pass; a match that fails is dropped."""
    digits = _digits(value)
    small = F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return F.when(kind == 1, small).when(kind == 2, F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)).when(kind == 3, F.length(digits).between(8, 15)).otherwise(True)


def _scan(text: Column, number: int) -> Column:
    """The matches of one expression: (scan, at, gap, size, value, contexts), in order."""
    regex, _, _, needs = _SCANS[number]
    parts = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), 0).alias("whole"))

    def placed(p: Column) -> Column:
        return F.transform(
            p["whole"],
            lambda m, i: F.struct(
                F.lit(number).alias("scan"), i.alias("at"), F.length(F.get(p["gaps"], i)).alias("gap"), F.length(m).alias("size"), m.alias("value"), _contexts(F.get(p["gaps"], i), F.get(p["gaps"], i + 1)).alias("contexts")
            ),
        )

    found = F.get(F.transform(F.array(parts), placed), F.lit(0))
    none = F.array().cast("array<struct<scan:int,at:int,gap:int,size:int,value:string,contexts:array<bigint>>>")
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(none)


def _contexts(left: Column, right: Column) -> Column:
    """Hashes of the lexical patterns around a match, of those that hold a letter. Words are in lower case, with digits masked.

    Words are cut off the ends of the whole gaps, however long these are; between two matches the same words can serve both.
    """
    blank = lambda gap: F.translate(gap, "\t\n\x0b\f\r", "     ")
    word = lambda w: F.translate(F.lower(w), "123456789", "000000000")
    last = lambda gap: F.substring_index(gap, " ", -1)
    before = lambda gap: F.rtrim(F.left(gap, F.length(gap) - F.length(last(gap))))

    def hashed(w: Column) -> Column:
        one, two, after = w["one"], w["two"], w["after"]
        lists = [F.array(two, one), F.array(one), F.array(after), F.array(one, after)]
        every = [F.when(F.forall(x, lambda y: y != "") & F.exists(x, lambda y: y.rlike(r"\p{L}")), F.xxhash64(F.lit(i), x)) for i, x in enumerate(lists)]
        return F.array_compact(F.array(*every))

    cut = lambda gap: F.struct(word(last(gap)).alias("one"), word(last(before(gap))).alias("two"), word(F.substring_index(F.ltrim(blank(right)), " ", 1)).alias("after"))
    return F.get(F.transform(F.transform(F.array(F.rtrim(blank(left))), cut), hashed), F.lit(0))


def scanned(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A checkpointed, numbered row per document: ``keep``, ``_n`` and the raw ``matches`` of all expressions. Null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return numbered(durable(docs.select(*keep, F.concat(*[_scan(text, i) for i in range(len(_SCANS))]).alias("matches"))), "_n")


def occurrences(scans: DataFrame, row: str = "_n") -> DataFrame:
    """Base matches that pass their checks and look-alikes that touch none of them.

    Columns: ``row, kind, start, end, base, value, patterns``. scans: rows of ``scanned``.
    """
    found = scans.select(row, F.explode("matches").alias("m")).select(row, "m.*")
    running = Window.partitionBy(row, "scan").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(running)
    kinds = F.element_at(F.array(*[F.lit(k) for _, k, _, _ in _SCANS]), F.col("scan") + 1)
    bases = F.element_at(F.array(*[F.lit(b) for _, _, b, _ in _SCANS]), F.col("scan") + 1)
    placed = found.select(row, kinds.alias("k"), bases.alias("base"), (end - F.col("size")).alias("start"), end.alias("end"), "value", "contexts")
    number = F.when((F.col("k") == 2) & ~F.col("base") & (F.length(_digits(F.col("value"))) < 13), 3).otherwise(F.col("k"))
    placed = placed.withColumn("kind", number).where(~F.col("base") | _valid(F.col("k"), F.col("value")))
    by_start = Window.partitionBy(row).orderBy("start", "end")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    value = F.when(F.col("kind") == 0, F.lower("value")).otherwise(_digits(F.col("value")))
    return placed.withColumn("_free", F.col("base") | free).where("_free").select(
        row, "kind", "start", "end", "base", value.alias("value"), F.transform("contexts", lambda c: F.xxhash64("kind", c)).alias("patterns")
    )


def confident_patterns(found: DataFrame) -> DataFrame:
    """Score the pattern-instance graph of ``occurrences``: the patterns that are trusted in the end, one column ``pattern``.

    Edges are distinct, so a value or a context that fills the table weighs once; sums are taken before anything is shuffled.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), F.xxhash64("kind", "value").alias("instance"), F.col("base").cast("int").alias("seed"))
    edges = durable(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = durable(edges.groupBy("instance").agg(F.max("seed").alias("trust")).where("trust = 1").select("instance", F.col("trust").cast("double").alias("trust")))
    trust, known = seeds, None
    while True:
        scored = edges.join(trust, "instance", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        share = (F.sum("trust") / (F.count(F.lit(1)) + SMOOTH)).alias("confidence")
        confident = durable(scored.groupBy("pattern").agg(share, F.sum((F.col("trust") >= CONFIDENT).cast("int")).alias("support")).where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)))
        n, total = confident.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if n == 0 or (known is not None and known[0] == n and total - known[1] < RESTS):
            return confident.select("pattern")
        known = n, total
        reached = edges.join(maybe_broadcast(confident), "pattern").select("instance", F.col("confidence").alias("trust"))
        trust = durable(reached.unionByName(seeds).groupBy("instance").agg(F.max("trust").alias("trust")))


def find_spans(scans: DataFrame, row: str = "_n") -> DataFrame:
    """Every span to report: ``row, kind, start, end, base``; those beyond the base rules come from trusted patterns."""
    found = durable(occurrences(scans, row))
    trusted = maybe_broadcast(durable(confident_patterns(found)))
    span = [row, "kind", "start", "end", "base"]
    more = found.where("NOT base").select(*span, F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi").select(*span).distinct()
    earlier = F.max("end").over(Window.partitionBy(row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    more = more.withColumn("_e", earlier).where("_e IS NULL OR _e <= start").drop("_e")
    return found.where("base").select(*span).unionByName(more)


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, counts of base matches by kind, ``base_sha256`` of their spans, and all ``spans``.

    Null and empty texts have no spans. Rows that repeat a doc_id, or have none, get one row each; other columns are ignored; an
    empty table gives no rows. Texts are read whole, and no expression tries a place twice, so very long ones cost in proportion.
    """
    scans = scanned(docs, ("doc_id",))
    one = F.struct("kind", "start", "end")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = find_spans(scans).groupBy("_n").agg(*counts, F.collect_list(F.when(F.col("base"), one)).alias("_b"), F.collect_list(one).alias("_s"))
    listed = spans.select("_n", *[f"n_{k}" for k in KINDS], _listed(F.col("_b")).alias("_b"), _listed(F.col("_s")).alias("spans"))
    joined = scans.select("doc_id", "_n").join(listed, "_n", "left")
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_b", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one, named by the first.

    All columns stay, whatever their names; a null text stays null, an empty one empty. Repeated rows are treated alike; an empty
    table gives no rows.
    """
    rows, name, spans = keyed(docs), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), f"{ROW}_spans"
    scans = scanned(rows, (ROW,))
    earlier = Window.partitionBy("_n").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    fresh = find_spans(scans).withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0)).cast("long"))
    listed = fresh.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "reach"))).alias(spans))
    listed = listed.join(scans.select(ROW, "_n"), "_n").drop("_n")

    def clean(text: Column, found: Column) -> Column:
        cut = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
        pieces = F.transform(F.filter(found, lambda x: x["start"] >= x["reach"]), lambda x: F.concat(cut(x["reach"], x["start"]), F.element_at(name, x["kind"] + 1)))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(found, lambda x: x["end"])), F.length(text).cast("long")))

    text = F.col("text")
    redacted = F.when(F.col(spans).isNull(), text).otherwise(clean(text, F.col(spans)))
    return rows.join(listed, ROW, "left").select(*[redacted.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
