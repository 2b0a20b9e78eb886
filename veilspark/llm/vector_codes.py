"""Product quantization of vectors in exact integers, with LAESA pivots that spare most distances.

Vectors become integers and are cut into parts; every part position has a codebook, which a few rounds of k-means improve. The distances
of each part to some fixed pivots are computed once and stored. In a round, the distances of pivots and entries give a lower bound of each part's
distance to each entry, the largest difference of two distances to a pivot; entries are tried from the least bound on, and only those whose bound
does not exceed the best distance found are evaluated, in integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted

#: Pivots of each part position; components are multiplied by SCALE before they are rounded down.
PIVOTS, SCALE = 4, 4096
#: Integers up to this size have squared distances that fit 64 bits, for parts of up to 2^13 components; beyond it Python's own integers are used.
SMALL = 1 << 24
#: Largest finite number of single precision: larger ones count as not finite.
_LARGEST = 3.4028234663852886e38
#: Sums travel as two numbers: what is above so many bits, and the rest.
_LOW_BITS = 60
Codebooks = list[list[list[int]]]


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, exactly."""
    scaled = vectors.astype(np.float64) * SCALE
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return np.floor(scaled).astype(np.int64)
    return np.array([math.floor(x) for x in scaled.ravel().tolist()], dtype=object).reshape(scaled.shape)


def _array(numbers: list, like: np.ndarray) -> np.ndarray:
    """Entries in the type that keeps differences to ``like`` exact."""
    found = np.array(numbers, dtype=object)
    small = like.dtype != object and (not found.size or max(map(abs, found.ravel().tolist())) < SMALL)
    return found.astype(np.int64) if small else found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    difference = a - b
    return (difference * difference).sum(axis=-1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def chosen_pivots(codebook: list[list[int]], n: int = PIVOTS) -> list[list[int]]:
    """Pivots from the first entries of a part position: the first one, then each time the one with the largest sum of distances to those chosen."""
    entries = np.array(codebook, dtype=object)
    chosen, far = [0], np.zeros(len(codebook))
    while len(chosen) < min(n, len(codebook)):
        far = far + _roots(_squares(entries, entries[chosen[-1]]))
        chosen.append(max((i for i in range(len(codebook)) if i not in chosen), key=lambda i: (far[i], -i)))
    return [codebook[i] for i in chosen]


def pivot_distances(parts: np.ndarray, pivots: Codebooks) -> np.ndarray:
    """Distances of n x positions parts to the pivots of their position, as n x positions x pivots."""
    found = [np.stack([_roots(_squares(parts[:, j], _array(p, parts))) for p in own], axis=-1) for j, own in enumerate(pivots)]
    return np.stack(found, axis=1)


def nearest(parts: np.ndarray, near: np.ndarray, codebooks: Codebooks, pivots: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """For n x positions parts with their pivot distances: the nearest entry (the first of equals), its squared distance, and how many
    distances were evaluated."""
    n, positions = parts.shape[:2]
    codes, errors, evaluated = np.zeros((n, positions), np.int64), np.zeros((n, positions), parts.dtype), 0
    for j in range(positions):
        own, entries = parts[:, j], _array(codebooks[j], parts)
        apart = np.stack([_roots(_squares(entries, _array(p, entries))) for p in pivots[j]])  # pivots x entries
        bound = np.zeros((n, len(entries)))
        for p in range(len(apart)):
            here = near[:, j, p, None]
            # Roots are rounded, so bounds give way by far more than that: an entry that is as near as the best is never passed over.
            np.maximum(bound, np.abs(here - apart[p]) - 1e-9 * (here + apart[p]), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        rows = np.arange(n)
        codes[:, j] = order[:, 0]
        first = _squares(own, entries[order[:, 0]])
        best = first.astype(object) if entries.dtype == object else first
        evaluated += n
        for rank in range(1, len(entries)):
            limit = _roots(best[rows]) * (1 + 1e-9)
            rows = rows[bound[rows, order[rows, rank]] <= limit]
            if not len(rows):
                break
            at = order[rows, rank]
            found = _squares(own[rows], entries[at])
            evaluated += len(rows)
            better = (found < best[rows]) | ((found == best[rows]) & (at < codes[rows, j]))
            moved = rows[better.astype(bool)]
            best[moved], codes[moved, j] = found[better.astype(bool)], at[better.astype(bool)]
        if best.dtype == object and errors.dtype != object:
            errors = errors.astype(object)
        errors[:, j] = best
    return codes, errors, evaluated


def _parts_of(batch: pa.RecordBatch, width: int, positions: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(batch.num_rows, positions, width // positions))


def _near_of(batch: pa.RecordBatch, positions: int) -> np.ndarray:
    return batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, positions, -1)


def _sums(width: int, positions: int, codebooks: Codebooks, pivots: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's parts, sums and counts by position, entry and component: as many rows as the codebooks have components, however many parts there are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _parts_of(batch, width, positions)
            codes, _, _ = nearest(parts, _near_of(batch, positions), codebooks, pivots)
            for j in range(positions):
                for entry in np.unique(codes[:, j]).tolist():
                    own = parts[codes[:, j] == entry, j]
                    held = totals.setdefault((j, entry), [0, [0] * own.shape[1]])
                    held[0] += len(own)
                    held[1] = [a + b for a, b in zip(held[1], own.sum(axis=0).tolist(), strict=True)]
        rows = [(j, e, k, n, Decimal(s >> _LOW_BITS), Decimal(s & ((1 << _LOW_BITS) - 1))) for (j, e), (n, sums) in totals.items() for k, s in enumerate(sums)]
        number = pa.decimal128(38, 0)
        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("high", number), ("low", number)])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, schema.types, strict=True)], schema=schema)

    return read


def _improved(rows: DataFrame, width: int, codebooks: Codebooks, pivots: Codebooks) -> Codebooks:
    """One round: every entry becomes the mean of its parts, rounded down; what comes to the driver is one row per component of the codebooks."""
    found = rows.select("embedding", "near").mapInArrow(_sums(width, len(codebooks), codebooks, pivots), "part int, entry int, place int, n long, high decimal(38,0), low decimal(38,0)")
    totals = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    fresh = [[list(entry) for entry in book] for book in codebooks]
    for r in totals.collect():
        fresh[r["part"]][r["entry"]][r["place"]] = ((int(r["high"]) << _LOW_BITS) + int(r["low"])) // r["n"]
    return fresh


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """The codes of all vectors, ``vec_id, label, codes array<int>, error, label_error``, and the codebooks.

    vectors has vec_id, embedding and label; other columns are ignored. Rows whose vector is null or holds a null or a component that is not
    finite in single precision are left out, and so are rows whose vector has not the length of the first one's, by vec_id, or is no multiple of
    ``positions`` long. The codebooks start with the vectors of the least vec_ids, null ones last, of equal ids the least vector;
    a table of fewer rows has fewer entries. Repeated rows are rows of their own and count as often in the means. error is the squared distance of a
    vector to its entries, summed over parts, label_error its sum over equal labels, nulls together; either is null beyond 64 bits. An empty table gives no rows
    and empty codebooks. The codebooks, entries x length integers whatever the number of rows, are all that the driver and the tasks share.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= _LARGEST)
    whole = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    long_enough = (F.size("embedding") >= positions) & (F.size("embedding") % positions == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    head = whole.where(long_enough).orderBy(*order).limit(1).collect()
    width = len(head[0]["embedding"]) if head else 0
    kept = whole.where(F.size("embedding") == width) if head else whole.limit(0)
    first = kept.orderBy(*order).limit(entries).select("embedding").collect()
    start = integers(np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), positions, width // positions)).tolist()
    codebooks: Codebooks = [[v[j] for v in start] for j in range(positions)]
    if not head:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), codebooks
    pivots = [chosen_pivots(book) for book in codebooks]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pivot_distances(_parts_of(batch, width, positions), pivots).reshape(batch.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    types = dict(kept.dtypes)
    rows = durable(kept.mapInArrow(measure, f"vec_id {types['vec_id']}, label {types['label']}, embedding {types['embedding']}, near array<double>"))
    for _ in range(rounds):
        codebooks = _improved(rows, width, codebooks, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors, _ = nearest(_parts_of(batch, width, positions), _near_of(batch, positions), codebooks, pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, positions), pa.int32()), pa.array(codes.ravel(), pa.int32()))
                sums = [s if s < 1 << 63 else None for s in errors.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(sums, pa.int64())], names=["vec_id", "label", "codes", "error"])

    coded = durable(rows.mapInArrow(assign, f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error long"))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    labels = durable(coded.select(key, "error").groupBy("_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("_n")))
    return join_counted(coded.select("*", key), labels, "_label", "_n").select("vec_id", "label", "codes", "error", "label_error"), codebooks
