"""Session set-up: runtime settings every job relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; each is applied only where the cluster has not set it already.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is worth an extra shuffle: one structure may hold a third of all atoms
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast by measured size only: estimates before a join or explode can be far too low
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16m",
    # few bytes can mean much work here (one atom meets hundreds of partners), so do not merge small tasks away
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows differ in size by orders of magnitude: batches for Python are bounded by bytes, not only by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


# Spark 4.1 may report a union as co-partitioned although adaptive coalescing cut its inputs differently, and
# then skips a shuffle the next aggregation needs: groups come out split. Correctness decides, always off.
_REQUIRED = {"spark.sql.unionOutputPartitioning": "false"}


# Rows of atoms and pairs take five to ten times their shuffled bytes in a sort or join: tasks of structure queries read a
# quarter of Spark's usual 64 MB, so that they keep to memory.
_STRUCTURES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def tune(spark: SparkSession, structures: bool = False) -> SparkSession:
    """Apply the runtime settings the operators (and with `structures` those on atoms) rely on, keeping any the cluster chose itself."""
    explicit = dict(spark.sparkContext.getConf().getAll())
    for key, value in {**_RUNTIME, **(_STRUCTURES if structures else {})}.items():
        if key not in explicit:
            spark.conf.set(key, value)
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", app: str = "latticework",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach. `spark.checkpoint.dir` wins; a local one only where unset."""
    for source in (spark.conf, spark.sparkContext.getConf()):
        found = source.get("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a costly intermediate once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later plans column pruning and true sizes. `compression` "zstd" is
    for rows of many numbers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
