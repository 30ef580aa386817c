"""Session builder and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024
#: Row groups of stored lines. Text packs so well that a file of the usual size is work for
#: minutes, and a file is read by one task for each row group at most.
LINES_ROW_GROUP = 4 * 1024 * 1024


def build_session(app_name: str = "logweft", **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by the cluster.

    Only a local master, where every task sees the same disk, may fall back to a
    temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweft-"))
        configured = spark.sparkContext.getCheckpointDir()
    # Libraries other than Spark take a path without scheme for one of their own machine.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(configured)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    shared = files.makeQualified(path).toString()
    return f"{shared}/logweft-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps then read columns instead of repeating the work, whatever
    happens to the executors that did it. ``row_group`` is the size in bytes of the
    pieces in which tasks can share a file.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(stored: DataFrame) -> None:
    """Delete the table behind ``stored``, which ``materialize`` wrote and nothing will read."""
    spark = stored.sparkSession
    own = work_dir(spark)
    for folder in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.makeQualified(path).toString().rpartition("/")[0] == own:
            files.delete(path, True)


def drop_work_dir(spark: SparkSession) -> None:
    """Delete what this application stored in the shared folder.

    Tables returned before must not be used afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input.

    A small columnar file is often a single row group, which one task has to read
    whole. Inputs of more than ``SPREAD_BYTES_PER_CORE`` are left as they are,
    without any shuffle. ``df`` must be a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, as measured now, stay below ``limit`` bytes."""
    width = F.octet_length(F.to_json(F.struct("*"))) + F.lit(64)
    size = df.select(F.sum(width.cast("bigint")).alias("size")).first()["size"]
    return (size or 0) <= limit


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_by: Column,
    how: str = "left",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join rows to a lookup table that is unique on ``on``.

    The table is broadcast if its measured size allows. Beyond that the join
    shuffles, with the big side salted by ``salt_by`` (a fixed value per row), as
    one key may hold a large part of all rows.
    """
    if fits_broadcast(small, limit):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
