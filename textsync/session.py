"""Session helpers: a local session for tests and the lineage cut used by iterative jobs."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, name: str = "textsync") -> SparkSession:
    """A local session with the settings used in tests and in the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    shared = os.environ.get("TEXTSYNC_SHARED", f"/tmp/spark-shared-{os.getpid()}")  # one machine: any folder is shared
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # small test tables hold few bytes but much work per byte: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, a folder of the warehouse
    is set, which Spark takes to be shared as well; a machine-local temporary folder is never used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
        configured = f"{warehouse}/_shared"
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_staged: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, kind: str = "stage") -> str:
    """A folder name below the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def remove_staged(spark: SparkSession | None = None) -> None:
    """Delete the folders made by ``stage``; tables read back from them must no longer be used."""
    while _staged:
        session, path = _staged.pop()
        try:
            target = session._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended: the cluster clears its shared folder
            continue


def staged_folders() -> list[str]:
    """The folders made so far and not yet removed, in their order."""
    return [path for _, path in _staged]


def release(folders: list[str], kept: DataFrame) -> None:
    """Delete those of ``folders`` that ``kept`` does not read; nothing else may still need them."""
    read = {part for file in kept.inputFiles() for part in file.split("/")}
    gone = {path for path in folders if path.rsplit("/", 1)[1] not in read}
    going = [x for x in _staged if x[1] in gone]
    _staged[:] = [x for x in _staged if x[1] not in gone]
    for session, path in going:
        target = session._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(remove_staged)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond files every executor can reach, so a lost executor costs a
    re-read only. Being parquet it stays columnar and carries its true size to the planner.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
