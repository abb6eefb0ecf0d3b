"""Session helpers: table access and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names. Only a session on one machine may do without and get its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are stored once and the lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """The URI of a fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``cut`` as compressed columns, for rows that are many: written once, read from there."""
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
