"""Near-duplicates by a chosen-path set similarity join (Christiani and Pagh; Christiani, Pagh and Sivertsen).

Every distinct shingle set gets a sketch of minwise tokens. A tree sends a set from a node to the children named by a few of
its minwise tokens, chosen by the node; sets that agree on a token meet in a child. Nodes of at most ``LEAF`` sets are
compared exhaustively on their sketches. Larger nodes are compared in random chunks, each with the node's pivots. What has been
found up to then makes candidate clusters, over all nodes and trees: a large node whose sets are of one cluster ends, one with
few sets of other clusters compares these with all of its sets, and any other branches on, by tokens in which its own
sets agree little, so that a passage shared by very many documents does not hold them together. A token on which a node has
branched is the same in all of a child's sets, so paths end after at most ``TOKENS`` levels; no level and no set is left out.
Independent trees repeat this until the target recall is met: a pair at the threshold misses all roots with probability
(1 - J) ** TREES.

Sketch agreement only forms candidate clusters. Links are confirmed on the full sets inside each cluster. A cluster too large
for a task is dealt into parts that each meet a few hubs; what is linked so far is contracted, and only sets outside the
cluster's largest fragment meet its other parts. Only spanning links leave a task, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, durable, join_counted, keyed, numbered
from .graph import components

#: Minwise tokens of a sketch, 16 bits each.
TOKENS = 48
#: Independent trees; tokens by which a node that is too large branches, out of so many in which its sets agree least.
TREES, BRANCH, CHOICE = 8, 3, 8
#: Sets in a node that is compared exhaustively, and pivots of a larger one.
LEAF, PIVOTS = 512, 8
#: Sets outside a node's largest cluster that are compared with the whole node; with more of them the node branches on.
FREE = 256
#: Agreeing tokens that make a candidate: 4.5 standard deviations under the similarity 0.8.
NEAR = 26
#: Sets and shingles that one confirming task holds at most, unless one set alone is larger; hubs that each part meets.
BLOCK_SETS, BLOCK_SHINGLES, HUBS = 2000, 1_000_000, 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, size=(2, TOKENS), dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles: ``width`` words, A to Z in lower case; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    q = min(width, len(h))
    m = len(h) - q + 1
    s = _mixed(h[:m] + np.uint64(q))
    for j in range(1, q):
        s = _mixed(s * _MIX + h[j : m + j])
    return np.unique(s)


def minwise(shingle: np.ndarray) -> bytes:
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle), 1 << 15):
        np.minimum(low, (shingle[i : i + (1 << 15), None] * (_SEEDS[0] | np.uint64(1)) + _SEEDS[1]).min(axis=0), out=low)
    return ((_mixed(low) * _MIX) >> np.uint64(48)).astype("<u2").tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: ``_row, doc_id, n_shingles, digest`` of the set and ``sketch``, the last two null for empty sets."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            sets = [shingles(t, width, known) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "_row": pdf["_row"],
                    "doc_id": pdf["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sketch": [minwise(s) if len(s) else None for s in sets],
                }
            )

    return docs.select("_row", "doc_id", "text").mapInPandas(sketch, "_row string, doc_id long, n_shingles long, digest binary, sketch binary")


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Re-cut batches sorted by ``key`` so that no group is split."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        start = int(np.searchsorted((pdf[key] == last).to_numpy(), True)) if pdf[key].iloc[0] != last else 0
        if start:
            kept.append(pdf.iloc[:start])
            yield pd.concat(kept)
            kept = [pdf.iloc[start:]]
        elif kept and kept[-1][key].iloc[-1] != last:
            yield pd.concat(kept)
            kept = [pdf]
        else:
            kept.append(pdf)
    if kept:
        yield pd.concat(kept)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _collisions(tokens: np.ndarray) -> list[int]:
    """For each token's place, in how many pairs of sets, each with itself too, the token is the same."""
    return [int((np.unique(column, return_counts=True)[1] ** 2).sum()) for column in tokens.T]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the sketches inside each node or chunk. Rows out: a spanning link (a, b), or for a chunk its node, its size squared and its collisions by place."""
    for pdf in _groups(batches, "key"):
        key, ids = pdf["key"].to_numpy(), pdf["cid"].to_numpy()
        tokens = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(-1, TOKENS)
        dealt = (pdf["large"] & ~pdf["pivot"]).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        room = np.repeat(starts + size, size) - np.arange(len(key))  # members from here to the group's end
        links = []
        for d in range(1, int(size.max())):
            i = np.flatnonzero(room > d)
            near = np.concatenate([(tokens[k] == tokens[k + d]).sum(axis=1) for k in np.array_split(i, len(i) // 65536 + 1)]) >= NEAR
            links.append(np.stack([i[near], i[near] + d]))
        a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
        root = _stars(len(key), a, b)
        joined = np.flatnonzero(root != np.arange(len(key)))
        yield pd.DataFrame({"a": ids[joined], "b": ids[root[joined]], "node": 0, "most": 0, "same": None})
        chunks = [(i, i + n) for i, n in zip(starts, size, strict=True) if dealt[i : i + n].any()]
        if chunks:
            own = [tokens[i:j][dealt[i:j]] for i, j in chunks]
            yield pd.DataFrame({"a": -1, "b": -1, "node": pdf["node"].to_numpy()[[i for i, _ in chunks]], "most": [len(t) ** 2 for t in own], "same": [_collisions(t) for t in own]})


_COMPARED = "a long, b long, node long, most long, same array<long>"


def _met(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Bring the sketches of ``node, key, cid, pivot, large`` together by key and compare them."""
    return placed.join(sets, "cid").repartition("key").sortWithinPartitions("key").mapInPandas(_compare, _COMPARED)


def _level(nodes: DataFrame, sizes: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Compare all nodes of one level: ``node, cid`` in, rows of ``_compare`` out."""
    no, yes = F.lit(False), F.lit(True)
    small = nodes.join(sizes.where(f"n BETWEEN 2 AND {LEAF}").select("node"), "node").select("node", F.col("node").alias("key"), "cid", no.alias("pivot"), no.alias("large"))
    inside = nodes.join(large, "node")
    chunk = F.xxhash64("node", F.pmod(F.xxhash64("cid", "node"), F.col("chunks")))
    dealt = inside.select("node", chunk.alias("key"), "cid", no.alias("pivot"), yes.alias("large"))
    first = inside.groupBy("node", "chunks").agg(*[F.min_by("cid", F.xxhash64("cid", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
    each = first.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p"))
    pivots = each.select("node", F.xxhash64("node", "c").alias("key"), F.explode("p").alias("cid"), yes.alias("pivot"), yes.alias("large"))
    return _met(small.unionByName(dealt).unionByName(pivots), sets)


def _settle(on: DataFrame, sets: DataFrame) -> DataFrame:
    """Finish nodes with few free sets: each of those meets every set of its node, dealt in chunks. Links as in ``_compare``."""
    no, yes = F.lit(False), F.lit(True)
    few = on.where("free").select("node", "cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), yes.alias("pivot"))
    dealt = on.where("NOT free").select("node", "cid", F.pmod(F.xxhash64("cid", "node"), F.col("chunks")).alias("c"), no.alias("pivot"))
    return _met(few.unionByName(dealt).select("node", F.xxhash64("node", "c").alias("key"), "cid", "pivot", no.alias("large")), sets)


def _choice(same: Column, most: Column) -> Column:
    """The places by which a node branches: of those where its sets agree least, and not all of them do, a few drawn by the node."""
    least = F.slice(F.sort_array(F.transform(same, lambda s, i: F.struct(s.alias("s"), i.alias("i")))), 1, CHOICE)
    split = F.filter(least, lambda x: x["s"] < most)
    drawn = F.sort_array(F.transform(split, lambda x: F.struct(F.xxhash64("node", x["i"]).alias("h"), x["i"].alias("i"))))
    return F.transform(F.slice(drawn, 1, BRANCH), lambda x: x["i"])


def _token(at: str) -> str:
    return f"substring(sketch, 2 * ({at}) + 1, 2)"


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """``node, component`` of the candidate clusters among ``sets`` (``cid, sketch``), from all trees and levels."""
    roots = F.array(*[F.xxhash64(F.lit(t), F.expr(_token(str(t * TOKENS // TREES)))) for t in range(TREES)])
    nodes, known = sets.select(F.explode(roots).alias("node"), "cid"), None
    while True:
        sizes = durable(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        large = sizes.where(f"n > {LEAF}").select("node", F.ceil(F.col("n") / LEAF).alias("chunks"))
        rows = durable(_level(nodes, sizes, large, sets))
        links = rows.where("same IS NULL").select("a", "b")
        known = durable(components(links if known is None else links.unionByName(known.toDF("a", "b"))))
        if large.isEmpty():
            return known
        label = F.coalesce("component", "cid")
        inside = durable(nodes.join(large, "node").join(known.withColumnRenamed("node", "cid"), "cid", "left").select("node", "cid", "chunks", label.alias("label")))
        counts = inside.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        held = counts.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("n_free")).where("n_free > 0")
        agreed = rows.where("same IS NOT NULL").groupBy("node").agg(F.sum("most").alias("most"), F.array(*[F.sum(F.col("same")[i]) for i in range(TOKENS)]).alias("same"))
        plans = durable(held.join(agreed, "node").select("node", "top", "n_free", _choice(F.col("same"), F.col("most")).alias("places")))
        few = (F.col("n_free") <= FREE) | (F.size("places") == 0)
        open_ = inside.join(plans.where(few).select("node", "top"), "node").select("node", "cid", "chunks", (F.col("label") != F.col("top")).alias("free"))
        found = durable(_settle(open_, sets)).select("a", "b")
        known = durable(components(found.unionByName(known.toDF("a", "b"))))
        on = plans.where(~few).select("node", "places")
        if on.isEmpty():
            return known
        child = F.transform("places", lambda i: F.xxhash64("node", i, F.substring(F.col("sketch"), 2 * i + 1, F.lit(2))))
        nodes = durable(inside.join(on, "node").join(sets, "cid").select(F.explode(child).alias("node"), "cid"))


def _confirm(width: int, percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for many in _groups(batches, "block"):
            out = []
            for _, pdf in many.groupby("block", sort=False):
                out += _linked(pdf["cid"].to_numpy(), [shingles(t, width, known) for t in pdf["text"]], percent, pdf["fragment"].to_numpy(), pdf["asks"].to_numpy())
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return confirm


def _linked(ids: np.ndarray, sets: list[np.ndarray], percent: int, fragment: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among full sets. A set that asks is compared with all sets that it is not yet joined with; equal fragments are joined."""
    size = np.array([len(s) for s in sets])
    label = np.unique(fragment, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    universe, dense = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.r_[0, np.cumsum(size)]
    flag = np.zeros(len(universe), bool)
    todo = np.flatnonzero(asks)[::-1].tolist()
    waits = asks.copy()
    while todo:
        x = todo.pop()
        if not waits[x]:
            continue
        waits[x] = False
        left = np.flatnonzero(label != label[x])
        left = left[(100 * np.minimum(size[left], size[x]) >= percent * np.maximum(size[left], size[x]))]
        if not len(left):
            continue
        flag[dense[cuts[x] : cuts[x + 1]]] = True
        both = np.add.reduceat(flag[np.concatenate([dense[cuts[i] : cuts[i + 1]] for i in left])].astype(np.int64), np.r_[0, np.cumsum(size[left])[:-1]])
        flag[dense[cuts[x] : cuts[x + 1]]] = False
        for i in left[100 * both >= percent * (size[x] + size[left] - both)]:
            if label[i] != label[x]:
                links.append((int(ids[i]), int(ids[x])))
                label[label == label[i]] = label[x]
                todo.append(int(i))  # what is joined asks next, so that the joined part grows and comparisons end early
    return links


def _links(blocks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed spanning links of ``block, cid, _row, fragment, asks``; each block is a task's."""
    return texts.select("_row", "text").join(blocks, "_row").drop("_row").repartition("block").sortWithinPartitions("block").mapInPandas(_confirm(width, percent), "a long, b long")


def confirmed(clusters: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, component`` over the links that full sets confirm inside candidate clusters.

    clusters: ``node, component``; classes: ``cid, n, _row``, a set's size and a row with its text; texts: ``_row, text``.
    A cluster of several parts costs one pass over its texts with a few hubs in each part, and one more in which what is outside
    its largest fragment, in chunks of a block's size, meets all parts; only a cluster without a fragment to speak of costs its square.
    """
    members = clusters.join(classes, F.col("node") == F.col("cid")).select("cid", "component", "n", "_row")
    totals = members.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"), *[F.min_by("cid", F.xxhash64("cid", F.lit(i))).alias(f"h{i}") for i in range(HUBS)])
    enough = F.greatest(F.lit(2), F.ceil(F.col("sets") / BLOCK_SETS), F.least("sets", F.ceil(F.col("total") / BLOCK_SHINGLES))).cast("long")
    whole = (F.col("sets") <= 2 * BLOCK_SETS) & (F.col("total") <= 2 * BLOCK_SHINGLES)
    sized = totals.select("component", F.when(whole, F.lit(1).cast("long")).otherwise(enough).alias("parts"), F.array_distinct(F.array(*[f"h{i}" for i in range(HUBS)])).alias("hubs"))
    placed = durable(members.join(sized, "component").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("hub", F.array_contains("hubs", F.col("cid")) & (F.col("parts") > 1)).drop("hubs"))
    all_parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    met = placed.select("cid", "_row", "component", F.explode(F.when(F.col("hub"), all_parts).otherwise(F.array("part"))).alias("at"))
    blocks = met.select("cid", "_row", F.xxhash64("component", "at").alias("block"), F.col("cid").alias("fragment"), F.lit(True).alias("asks"))
    joined = durable(components(durable(_links(durable(blocks), texts, width, percent))))
    big = placed.where("parts > 1")
    if big.isEmpty():
        return joined
    pieces = durable(big.join(joined.select(F.col("node").alias("cid"), F.col("component").alias("fragment")), "cid", "left").withColumn("fragment", F.coalesce("fragment", "cid")))
    largest = pieces.groupBy("component", "fragment").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max_by("fragment", F.struct("k", "fragment")).alias("top"))
    split = pieces.join(largest, "component").withColumn("free", F.col("fragment") != F.col("top"))
    rest = split.where("free").groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.least(F.count(F.lit(1)), F.ceil(F.sum("n") / BLOCK_SHINGLES))).cast("long").alias("chunks"))
    split = durable(split.join(rest, "component").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks"))))
    cell = lambda part, chunk: F.xxhash64("component", part, chunk)
    every_chunk = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    stays = split.select("cid", "_row", "component", "fragment", "part", "chunk", "free", F.explode(every_chunk).alias("c"))
    stays = stays.select("cid", "_row", cell("part", F.col("c")).alias("block"), "fragment", (F.col("free") & (F.col("c") == F.col("chunk"))).alias("asks"))
    asks = split.where("free").select("cid", "_row", "component", "fragment", "part", "chunk", F.explode(all_parts).alias("p")).where("p <> part")
    asks = asks.select("cid", "_row", cell(F.col("p"), "chunk").alias("block"), "fragment", F.lit(True).alias("asks"))
    links = durable(_links(durable(stays.unionByName(asks)), texts, width, percent))
    return components(links.unionByName(joined.toDF("a", "b")))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, key: str | None = None) -> DataFrame:
    """Group documents linked by a Jaccard similarity of their shingle sets of at least ``percent`` hundredths.

    docs needs doc_id and text; other columns are ignored, but for ``key``, which names a column with a lasting string key of the
    row if there is one. Returns per row:
    ``_row, doc_id, n_shingles, component_id, kept, stays``. component_id is the smallest doc_id reachable over links; kept
    says that it is the row's own; stays is true for exactly one row of each component, also where doc_ids repeat or are
    null. Texts without words are linked with nothing. Equal sets count once, so exact copies cost one comparison in all.
    """
    texts = (docs if key else keyed(docs)).select(F.col(key or ROW).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(sketches(texts, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_row"))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("first"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = numbered(durable(classes), "cid")
    clusters = candidate_clusters(classes.select("cid", "sketch"))
    linked = confirmed(clusters, classes.select("cid", "n", F.col("first._row").alias("_row")), texts, width, percent)
    labelled = durable(classes.select("cid", "digest", "first", "copies").join(linked, F.col("cid") == F.col("node"), "left").select("digest", "first", "copies", F.coalesce("component", "cid").alias("component")))
    lowest = labelled.groupBy("component").agg(F.min("first").alias("low"))
    named = labelled.join(lowest, "component").select("digest", "copies", F.col("low.doc_id").alias("_low"), F.col("low._row").alias("_stay"))
    joined = join_counted(rows, durable(named), "digest", "copies")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("_low"))
    return joined.select(
        "_row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), (alone | (F.col("_row") == F.col("_stay"))).alias("stays")
    )
