"""Session set-up for tests, the bench and local runs."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="8", shuffle_partitions=8):
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxelmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark):
    """Use the folder the cluster names; a private one only in local mode, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxelmill-ckpt-"))


def stored(df: DataFrame, name) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage as a checkpoint does, but is compressed, and
    columns that are not wanted are not read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
