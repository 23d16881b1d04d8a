"""Session helpers: Spark settings the operators rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("framesieve")
    # Small tables of texts grow many times when they are cut into n-grams; parts of a megabyte would leave cores without work.
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.files.openCostInBytes": "64k"}
    conf = DEFAULTS | small | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the one set on the context. A folder of this machine serves only a local master;
    on a cluster each executor would write to its own disk, so there a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        own = context._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "framesieve-checkpoints")
    return folder


def _folder_of(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet below the shared folder and read it back: lineage ends here, and the rows survive the loss of any executor.

    The tables of an application lie in one folder that is deleted when it ends; released() deletes one earlier."""
    spark = df.sparkSession
    own = f"{checkpoint_folder(spark)}/framesieve-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, there = _folder_of(spark, own)
    files.deleteOnExit(there)
    return spark.read.parquet(path)


def released(df: DataFrame) -> None:
    """Delete the files of a table that stored() gave, once no later job reads it."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/framesieve-" in path:
            files, there = _folder_of(df.sparkSession, path)
            files.delete(there, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once; for sessions whose workers cannot import it."""
    context = spark.sparkContext
    if not getattr(context, "_framesieve_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="framesieve-"), "framesieve.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(package):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        context._framesieve_shipped = True
    return spark
