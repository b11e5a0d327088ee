"""Session, table access and durable cuts of lineage."""

from __future__ import annotations

import atexit
import gc
import os
import pathlib
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that come more than once, up to which they are sent to every task.
REPEATED = 1 << 21


def build_session(cpus: int | str = "*", app: str = "lexforge", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_folder(prefix: str) -> str:
    """A folder of this process, gone with it."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, True)
    return path


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each context, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lexforge_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(_local_folder("lexforge-")) / "lexforge.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._lexforge_shipped = True


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files) of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; choose a folder only for a local master."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(_local_folder("lexforge-cut-"))


def cut_counted(frame: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and the number of rows, counted without another plan."""
    out = cut(frame)
    return out, out._jdf.queryExecution().toRdd().count()


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder now and go on from there.

    The result survives the loss of executors and the plan behind it is forgotten,
    so loops don't grow their lineage. A checkpoint alone would carry the optimizer's
    size estimates and constraints along, which multiply with every join of a loop;
    the frame is made anew from the rows, and adaptive execution measures real sizes.
    """
    spark = frame.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    kept = frame._jdf.checkpoint(True)
    fresh = spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    return DataFrame(fresh, spark)


def _scratch(spark: SparkSession) -> str:
    """This application's folder below the checkpoint folder; it is removed when the process ends."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    if not hasattr(context, "_lexforge_scratch"):
        path = f"{context._jsc.sc().getCheckpointDir().get()}/lexforge-{uuid.uuid4().hex}"
        context._lexforge_scratch = path

        def remove() -> None:
            if context._jsc is not None:
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

        stop = context.stop

        def stop_clean() -> None:
            try:
                remove()
            except Exception:  # noqa: BLE001 - the folder may be gone, and stopping goes on
                pass
            stop()

        context.stop = stop_clean
    return context._lexforge_scratch


def keep(frame: DataFrame) -> DataFrame:
    """Write the rows as a table of columns to the checkpoint folder and go on from it.

    Like cut(), for wide tables that are read several times by few columns each.
    """
    spark = frame.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def once(frame: DataFrame, key: str) -> DataFrame:
    """distinct() of rows of which few come again, and those with the same key.

    Only rows whose key does come again are moved and written; the others are read where
    they lie, each time. With too many such keys all rows are moved, to the same result.
    """
    # a hash is never null; rows that only share it are told apart by distinct()
    keyed = frame.withColumn("_key", F.xxhash64(key))
    again = keep(keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    if again.count() > REPEATED:
        return frame.distinct()
    several = keep(keyed.join(F.broadcast(again), "_key", "left_semi").drop("_key").distinct())
    return keyed.join(F.broadcast(again), "_key", "left_anti").drop("_key").unionByName(several)


def tidy(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints of frames that are no longer used removed now, not when the driver's memory is short.

    What the first collection lets go of holds other frames, which the second one finds.
    """
    for wait in (0.2, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)
