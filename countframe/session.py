"""Spark session helpers.

The library never owns the cluster configuration: on a cluster the session
comes from the caller, and only settings that are *unset* get a default here.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on (adaptive re-planning, skew splitting, Arrow
# batches for the few Pandas functions).  Applied only when unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "countframe", driver_memory: str = "8g") -> SparkSession:
    """A local[N] session for tests, benches and the smoke entry."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        # checkpoint files of a frame are removed once the frame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_library(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    (tests) without that setting gets a private folder under the system temp
    directory; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="countframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/countframe-{spark.sparkContext.applicationId}"


def cut_lineage(df):
    """Write ``df`` once as Parquet into the shared checkpoint folder (never a
    machine-local one on a cluster) and return a frame that reads it back.

    Later stages read the written copy, so a lost executor costs no
    recomputation of the plan, and scans stay columnar (pruned columns,
    pushed filters).  The shuffle files behind it are removed once it is
    written, the folder when the application ends."""
    return _written(df)


def cut_by(df, by: str):
    """``cut_lineage`` with a folder for each of the few values of ``by``: a
    filter on it reads only those it needs."""
    return _written(df, by)


def _written(df, by: str | None = None):
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    _drop_at_exit(spark)
    schema = df.schema
    with shuffles_removed(spark):
        (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    frame = spark.read.schema(schema).parquet(path)
    frame._written_at = path
    return frame


def discard(frame) -> None:
    """Delete what ``cut_lineage`` wrote, of a frame that nothing will read again."""
    path = frame.__dict__.pop("_written_at", None)
    if path:
        sc = frame.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark removes a query's shuffle files when it ends, not when the driver
    happens to collect its garbage (unless the session says otherwise)."""
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


_SCRATCH: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    """Delete the application's scratch folder when the driver's Python ends
    (best effort: a session that is already stopped leaves it behind)."""
    path = scratch_dir(spark)
    if path in _SCRATCH:
        return
    _SCRATCH.add(path)
    sc = spark.sparkContext

    def drop() -> None:
        if sc._jsc is None:
            return
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(drop)


_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Make ``countframe`` importable in the Python workers (once per
    application): the Arrow functions of the kNN kernel, the projection and
    the attributions refer to functions of this package.  The package is
    zipped on the driver and distributed by Spark itself (``addPyFile``),
    the same as ``--py-files`` would."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no driver-side context: the package must be installed
        return
    if sc.applicationId in _SHIPPED:
        return
    import shutil

    import countframe

    pkg_dir = os.path.dirname(os.path.abspath(countframe.__file__))
    staging = tempfile.mkdtemp(prefix="countframe-lib-")
    archive = shutil.make_archive(os.path.join(staging, "countframe"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="countframe")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
