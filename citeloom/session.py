"""Sessions, checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
_SHIPPED: set[str] = set()


def build_session(app: str = "citeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; further settings by keyword, dots as underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application, wherever the driver found it."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    _SHIPPED.add(application)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="citeloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/citeloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(f"{folder}/citeloom.zip")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset (local runs only)."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder of written tables in the shared checkpoint folder; it goes when the driver's Python ends, or with drop_scratch."""
    folder = f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(drop_scratch, spark, folder)
    return folder


def drop_scratch(spark: SparkSession, folder: str | None = None) -> None:
    """Deletes the written tables; frames that read them are of no more use."""
    try:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder or scratch_dir(spark))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table to the shared checkpoint folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed on keys into as many partitions as the session asks for, two for each core at least: for joins whose work is in the pairs, not in the bytes, which adaptive execution would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def widened(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than the session has cores dealt out to all of them, for work that is far dearer than its bytes; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
