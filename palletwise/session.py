"""Session helpers.

Library code never creates its own session; it takes the caller's.  These
helpers are for tests, the bench and local runs.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "palletwise") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Taken from ``spark.checkpoint.dir`` when the cluster names one.  Where it
    is unset, a local master gets a scratch folder; a cluster fails.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext (e.g. remote)
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = str(getattr(sc, "master", "local")) if sc is not None else "remote"
        if not master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="palletwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder name under the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:16]}"


#: Spark removes the shuffle files of a query once it has ended
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Queries started meanwhile give their shuffle files back when they end
    (otherwise they stay until the driver's garbage collector finds them
    unused).  A setting the session makes itself is left as it is."""
    if spark.conf.get(SHUFFLE_CLEANUP, None) == "true":
        yield
        return
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def _write_stage(df, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return path


def stage(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint
    folder and reading it back.

    Columnar and compressed (cheaper than an RDD checkpoint), survives the
    loss of executors, and every later job over the result sees exactly the
    same rows.  The shuffle files of the write are removed when it has ended:
    nothing reads them again.  The folder is unique per call."""
    return df.sparkSession.read.parquet(_write_stage(df, name))


class Stages:
    """Staged tables of one step, as a context: called like ``stage``; all
    are removed at the end (also after an error), so a result that is used
    beyond the context must itself have been written with ``stage``."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df, name: str = "stage"):
        path = _write_stage(df, name)
        self._paths.append((df.sparkSession, path))
        return df.sparkSession.read.parquet(path)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *exc) -> None:
        self.clear()

    def clear(self, keep: int = 0) -> None:
        """Removes all but the last ``keep`` tables."""
        while len(self._paths) > keep:
            spark, path = self._paths.pop(0)
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df, *keys: str, target: int | None = None):
    """Give a scan enough partitions to use the whole cluster.

    A small input stored as one file / one row group is read by one task,
    which then also runs every projection above it.  When the scan has fewer
    partitions than the cluster's default parallelism, it is hash-spread on
    ``keys`` (round-robin if none); large inputs, whose scans already have
    at least that many splits, are returned unchanged -- no extra shuffle at
    scale."""
    spark = df.sparkSession
    try:
        want = target or spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= want:
            return df
    except Exception:  # no RDD view of the plan available: leave it alone
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized for an input of ``input_bytes`` on a cluster
    with ``total_cores`` task slots.

    Shuffle partitions are sized so that, before AQE coalescing, a partition
    holds about ``target_partition_bytes`` if the shuffle moved the whole
    input (the roll-ups move far less after their map-side combine), kept
    between 2x and 8x the slots: more reduce partitions than that mostly grows
    the map-output bookkeeping on the driver (map tasks x reduce partitions).
    AQE then coalesces small partitions towards the advisory size and splits
    skewed join partitions."""
    parts = min(8 * total_cores, max(2 * total_cores, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(min(512 << 20, max(64 << 20, target_partition_bytes))),
        "spark.sql.session.timeZone": "UTC",
    }


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Make this package importable by the executors' Python workers (the
    programmatic form of ``--py-files``), once per application.  Needed by
    the few jobs that run Python on executors (file sniffing, workbook
    parsing); harmless where the package is installed cluster-wide."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote sessions ship code differently
        return
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import palletwise

    pkg_dir = os.path.dirname(os.path.abspath(palletwise.__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="palletwise-pyfiles-"), "palletwise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def expired_stages(spark, older_than_minutes: float) -> list[tuple[str, float]]:
    """Staged intermediates (``stage``/``scratch_path`` folders) under the
    session's checkpoint folder older than ``older_than_minutes``: a list of
    (path, age in minutes), oldest first.  Selection only -- remove them once
    no job still reads them (their DataFrames read lazily)."""
    import time

    root = checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    now_ms = time.time() * 1000
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and "-" in name and len(name.rsplit("-", 1)[-1]) == 16:
            age = (now_ms - st.getModificationTime()) / 60000.0
            if age > older_than_minutes:
                out.append((st.getPath().toString(), age))
    return sorted(out, key=lambda x: -x[1])
