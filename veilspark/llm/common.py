"""What the operators of this subpackage share: lineage cuts, row ids and reading tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows and measured bytes stay under these; beyond them a shuffled join is planned.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20
#: A key is hot when it holds more than one of so many parts of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; set an own one only for a local session that has none (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veilspark-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    _let_go(df.sparkSession)
    return done


_last_let_go = 0.0


def _let_go(spark: SparkSession) -> None:
    """Free the shuffles, and where the session says so the checkpoints, to which nothing refers any more.

    Spark frees them when the driver collects its garbage. A loop whose work is on executors makes little of that, so the files of
    all its rounds would stay; asking for it now and then keeps those of the last few.
    """
    global _last_let_go
    if time.monotonic() - _last_let_go > 2:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _last_let_go = time.monotonic()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: rows of files keep their place, so ``keyed`` copies nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of a checkpointed table by partition and position; only there are these numbers the same in every pass."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Name of the key column; no table is expected to have it.
ROW = "_veilspark_row"


def keyed(df: DataFrame, name: str = ROW) -> DataFrame:
    """Give every row a key that is the same in every pass over ``df``, whatever executors come and go between them.

    Rows of files are keyed by file and place in the file. Other tables have no lasting place, so they are checkpointed first.
    """
    try:
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
        return df.select("*", place.alias(name))
    except AnalysisException:
        return durable(df).withColumn(name, F.monotonically_increasing_id().cast("string"))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after counting rows and measuring bytes; ``df`` should be durable, so that this is cheap."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    n, most = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (most or 0) <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of ``rows`` with ``named``, which has one row for each key and in ``count`` how many of the rows have it.

    Hot keys are joined where their rows are stored, by a broadcast of fewer than ``HOT_KEYS`` rows; rows without a key stay where
    they are as well; only the others are shuffled. Both tables should be durable.
    """
    hot = F.broadcast(durable(named.where(F.col(count) * HOT_KEYS > rows.count())))
    marked = rows.join(hot.select(key, F.lit(True).alias("_hot")), key, "left")
    still = F.col("_hot").isNotNull() | F.col(key).isNull()
    return marked.where(still).drop("_hot").join(hot, key, "left").unionByName(marked.where(~still).drop("_hot").join(named, key, "left"))
