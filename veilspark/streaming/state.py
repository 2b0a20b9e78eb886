"""Streams that keep state: repeats within a watermark, risk by user, and streams run to their end into a table.

Late rows: a row whose time is before the watermark, the latest time seen less ``late``, is left out where windows are closed
(``append``) and by ``distinct_within``; ``user_risk`` counts it, as a sum has no order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """A table of Parquet files as a stream, ``files`` of them at a time. The path is a folder or one file, which a stream takes only where it is a pattern."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def distinct_within(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: a repeat that comes while the key is remembered goes. State is bounded by the keys of ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def user_risk(stream: DataFrame, user: str, weight: str) -> DataFrame:
    """How many detections each user has and what they weigh, again for every user of whom some arrived: user, n, weight, seen.

    The state of a user is three numbers. ``seen`` counts up with every row that is given out, so the last one is known whatever their order.
    """
    kind = stream.schema[user].dataType.simpleString()

    def add(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, seen = state.get if state.exists else (0, 0, 0)
        for pdf in parts:
            n, total = n + len(pdf), total + int(pdf[weight].sum())
        state.update((n, total, seen + 1))
        yield pd.DataFrame({user: [key[0]], "n": [n], "weight": [total], "seen": [seen + 1]})

    return stream.select(user, weight).groupBy(user).applyInPandasWithState(add, f"{user} {kind}, n long, weight long, seen long", "n long, weight long, seen long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it gave out, with ``_batch``; in mode "complete" the last batch is the whole result.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves no repeats; started again with the same folder, the
    stream goes on where it stopped.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/_batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    spark = stream.sparkSession
    found = spark.read.schema(StructType([*stream.schema.fields]).add("_batch", "long")).parquet(f"{folder}/out")
    return found.where(F.col("_batch") == found.agg(F.max("_batch")).first()[0]) if mode == "complete" else found
