"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, one process on one machine takes a folder of its own; a cluster can't."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; then `drop` of ``done``.

    What comes back has no lineage and is taken to be as large as its files. A checkpoint's frame keeps the estimate of the
    plan that made it, which joins multiply: over rounds it would become a number of thousands of digits, and the
    driver would plan for minutes. Columns keep names and types, also names that differ in case alone, and may be null.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    void = [isinstance(f.dataType, NullType) for f in df.schema]
    places = df.toDF(*[f"c{i}" for i in range(len(void))])
    places.select(*[F.col(c).cast("int").alias(c) if v else F.col(c) for c, v in zip(places.columns, void)]).write.parquet(path)
    schema = StructType([StructField(c, f.dataType) for c, f, v in zip(places.columns, df.schema, void) if not v] or [StructField("c0", places.select(F.col("c0").cast("int")).schema[0].dataType)])
    back = spark.read.schema(schema).parquet(path)
    out = back.select(*[(F.lit(None) if v else F.col(c)).alias(name) for c, name, v in zip(places.columns, df.columns, void)])
    out._files = path
    drop(*done)
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of frames that `cut` gave, such as those of a round that is over; other frames have none. Nothing that reads them may be used again."""
    for df in frames:
        if getattr(df, "_files", None) is not None:
            remove(df.sparkSession, df._files)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
