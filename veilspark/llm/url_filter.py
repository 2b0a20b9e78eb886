"""URL filters: a trie over reversed host labels and path segments, with the longest match deciding between allow and block entries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, ROW, keyed

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands after the first "://": the host, then the path.
_PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Trie:
    """Rules (verdict, host, path). A node of the host trie is [children by label, paths]; labels are read from the right. A node of
    a path trie is [children by segment, tails]: a tail is what a rule's path has after its last slash, with the rule and its verdict.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}]
            *segments, tail = path.split("/")
            at = node[1]
            for segment in segments:
                at = at[0].setdefault(segment, [{}, {}])
            at[1][tail] = max(at[1].get(tail, ("", "")), (verdict, f"{host}{path}"))  # of two verdicts for one rule "block" is the greater

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits and its verdict: the one with most host labels, of these the one with the longest path."""
        node, paths = self.root, [self.root[1]]
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            paths.append(node[1])
        pieces = path.split("/")
        for at in reversed(paths):
            best = None
            for i, piece in enumerate(pieces):
                if at is None:
                    break
                if at[1]:
                    fits = [t for t in at[1] if len(t) <= len(piece) and piece.startswith(t)] if len(at[1]) <= len(piece) else [piece[:n] for n in range(len(piece) + 1) if piece[:n] in at[1]]
                    best = at[1][max(fits, key=len)] if fits else best
                at = at[0].get(piece) if i + 1 < len(pieces) else None
            if best:
                return best[1], best[0]
        return None, None


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: what follows the first "://" up to "/", "?" or "#", A-Z in lower case, and then up to "?" or "#"."""
    part = lambda n: F.coalesce(F.regexp_extract(url, _PLACE, n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for host, path in parts:
            yield pd.DataFrame([match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object)

    return urls.withColumn("_judged", judged("host", "path")).select("page_id", "host", "path", "_judged.rule", F.coalesce("_judged.verdict", F.lit(default)).alias("verdict"))


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules of any number: a url meets the rules of each suffix of its host and each leading run of segments, as deep as any rule is."""
    stem = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    listed = rules.select("verdict", "host", F.col("path").alias("rule_path"), stem.alias("stem"), F.concat("host", "path").alias("rule"))
    deepest = listed.agg(F.max(F.size(F.split("stem", "/", -1)))).first()[0] or 1
    labels = "filter(split(host, '[.]', -1), x -> host <> '')"
    suffixes = f"transform(sequence(0, size({labels})), i -> named_struct('n', size({labels}) - i, 's', array_join(slice({labels}, i + 1, size({labels})), '.')))"
    stems = f"transform(sequence(0, least({deepest}, size(split(path, '/', -1))) - 1), k -> substring_index(path, '/', k) || CASE WHEN k > 0 THEN '/' ELSE '' END)"
    rows = keyed(urls)
    met = rows.select(ROW, "path", F.explode(F.expr(suffixes)).alias("h"), F.expr(stems).alias("stems")).select(ROW, "path", "h", F.explode("stems").alias("stem"))
    fits = met.join(listed, (F.col("h.s") == listed["host"]) & (met["stem"] == listed["stem"]) & F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy(ROW).agg(F.max(F.struct(F.col("h.n").alias("n"), F.length("rule_path").alias("m"), "verdict", "rule")).alias("best"))
    return rows.join(best, ROW, "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of pages. rules: verdict ("allow" or "block"), host and path, as a table or listed.

    A rule fits its host and all subdomains of it if the path of the url starts with the rule's; an empty host fits all. Of the rules that fit
    the one with most host labels decides, then the one with the longest path, then "block"; where none fits, ``rule`` is null and
    ``default`` the verdict. Rules are brought to all tasks as a trie when they are few and small (counted and measured), else joined.

    Only page_id and url are read, so other columns may have any name. A null url and one without "://" have an empty host and
    path; a null page_id is kept; repeated rows are repeated; an empty table gives no rows; urls are read whole, however long. A port or
    a user's name is part of the host, as a final dot is. Rules without a known verdict or with a null host fit nothing; a null path is empty.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where(F.col("verdict").isin(ALLOW, BLOCK) & F.col("host").isNotNull())
    host, path = parsed(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    bytes_ = F.octet_length("host") + F.octet_length("path")
    n, size = rules.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_.cast("long")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return _by_trie(urls, [tuple(r) for r in rules.collect()], default)
    return _by_join(urls, rules, default)
