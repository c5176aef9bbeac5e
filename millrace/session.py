"""Session helpers: table access, shared scratch storage and materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that none needs it installed or on its path."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-code-")  # on the driver only; Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/millrace.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"millrace/{f.relative_to(root)}")
    sc.addPyFile(f"{folder}/millrace.zip")
    sc._millrace_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on rows of few input splits (a small file is one split); otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset, in local mode,
    a folder of this process is made and removed at exit; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return "file://" + _LOCAL_DIR[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, whatever file system it is on."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


_SCRATCH: list[str] = []
_REGISTERED: list = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder, removed by :func:`release` or at exit."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    if not _REGISTERED:
        _REGISTERED.append(atexit.register(release, spark))
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete scratch folders but the ``keep`` latest; for drivers that live long, once results are written. Returns how many."""
    gone = _SCRATCH[: len(_SCRATCH) - keep]
    del _SCRATCH[: len(gone)]
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as compressed parquet in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and is smaller than an RDD checkpoint
    since columns are encoded.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int = 8, memory: str = "6g", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark
