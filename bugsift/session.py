"""Session helpers: building a session for tests/bench and cutting lineage.

Library code never invents storage locations: lineage is cut with tables written
below the folder the cluster names in ``spark.checkpoint.dir``. Only the local
helpers used by tests and ``bench.py`` set that folder, and only when it is unset.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Rounds run by the iterative operators (connected components, Borůvka, Ward),
# per loop name; read and reset by bench.py. Driver-side counters only.
LOOP_ROUNDS: dict[str, int] = {}


def count_round(loop: str) -> None:
    LOOP_ROUNDS[loop] = LOOP_ROUNDS.get(loop, 0) + 1


def local_session(cpus: int | str = "*", app: str = "bugsift",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine (``local[cpus]``)."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local_default=True)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local_default: bool = False) -> str:
    """Return the reliable checkpoint folder, reading ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the cluster's own
    configuration. ``allow_local_default`` creates a fresh scratch folder when
    nothing is configured, and only if the master is this machine: executors
    elsewhere would each write to a folder of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not allow_local_default or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(
                "no checkpoint folder: set spark.checkpoint.dir to shared storage "
                "(iterative operators cut lineage with reliable checkpoints)")
        conf_dir = tempfile.mkdtemp(prefix="bugsift-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table below ``spark.checkpoint.dir`` and read
    it back. Lost executors reread it, and the new plan knows the table's true
    size: ``checkpoint()`` keeps the estimate of the plan it cut, which joins
    multiply from one round of a loop to the next."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._state_folder = folder
    return out


def drop_state(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` that no later plan reads (a round's state
    once the next one is written)."""
    for df in tables:
        folder = getattr(df, "_state_folder", None)
        if folder:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            df._state_folder = None


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make ``bugsift`` importable in the Python workers (kernels and UDFs are
    pickled by reference): zip the package once per SparkContext and add it
    with ``addPyFile`` -- the same mechanism as ``--py-files`` on a cluster.
    No-op when the workers already see it (e.g. installed on every node)."""
    sc = spark.sparkContext
    if getattr(sc, "_bugsift_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="bugsift-pyfiles-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "bugsift"), "zip", root_dir=root, base_dir="bugsift")
    sc.addPyFile(archive)
    sc._bugsift_shipped = True
