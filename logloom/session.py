"""Session construction and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def local_session(app: str = "logloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own; executors of a real
    cluster could not read such a folder, so there its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        root = _local_roots.setdefault(app, tempfile.mkdtemp(prefix="logloom-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/logloom/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove what a job wrote below its scratch folder, on whatever file system that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise a frame reliably, so lost executors never replay what is behind it."""
    scratch_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after a frame was cut off from copies many
    times its size; called where a job has passed such copies. What the first collection lets go holds shuffles
    until the cleaner, a thread of its own, has been at it, so there are several.
    """
    gc.collect()
    for pause in (0.5, 0.5, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
