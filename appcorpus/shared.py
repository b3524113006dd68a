"""The folder that the driver and all executors share: checkpoints and intermediate tables go there."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where driver and executors are one process may it be a local one of our own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = sc.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows go to the shared checkpoint folder, from where any executor can read them again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage like `cut`, by a Parquet table in the shared folder: computed once, and a fraction of a checkpoint's rows in size."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in whatever store it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
