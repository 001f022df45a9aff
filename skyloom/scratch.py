"""Written tables in the cluster's shared folder, used to cut lineage, and a few plan helpers built on them.

A stored table survives lost executors, unlike a local checkpoint, and is read
with column pruning by every later stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count proves that it has no more rows than this.
BROADCAST_ROWS = 50_000
#: Shuffle files go when the query that wrote them ends. They stay until the driver happens to collect its garbage otherwise, which is the rarer the larger the tables are.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a fresh local one only where it is unset and the master is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write `df` once as Parquet in the shared folder, compressed by zstd at `level`, and return the table read back. Nothing reads the query's shuffle files again, so they go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of `df` if its counted number of rows is under the bound; else leave it to a shuffled, skew-aware join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over all shuffle partitions, before columns or joins that cost much a row: a small file, or a shuffle of few bytes, is one task's work otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ordered_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of `df` from 0 in the given order, without one task seeing all of them.

    Ranges are sorted separately; what goes before a range is a sum over one
    count for each range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = store(ranged.withColumn("__m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__m", 33)
    counts = {r["__part"]: r["count"] for r in rows.groupBy(part.alias("__part")).count().collect()}  # one row for each range
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    offsets = F.array(*[F.lit(n).cast("long") for n in before])  # folded once, indexed by the range's number
    return rows.withColumn(name, F.get(offsets, part.cast("int")) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")
