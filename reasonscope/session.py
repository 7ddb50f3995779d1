"""SparkSession helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "reasonscope",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster, leave ``master`` None and size ``shuffle_partitions`` to the
    data (AQE coalesces small partitions at run time).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names in
    ``spark.checkpoint.dir``. Only a local session without one gets a scratch
    directory; on a cluster that would be one machine's disk, so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="reasonscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, through
    Spark's own file distribution. Workers need it where the package isn't
    installed on the executors or the driver was started in another folder."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not package.is_dir():  # in a zip: shipped by the user
        return
    archive = Path(tempfile.mkdtemp(prefix="reasonscope-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


_KEPT: list[DataFrame] = []


def release() -> int:
    """Drop every result that ``materialize`` cached in this process; how many there
    were. For after a job's tables are written."""
    number = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist()
    return number


def materialize(df: DataFrame, mode: str = "persist") -> DataFrame:
    """Keep an intermediate result that several consumers read.

    ``persist``: cached (memory, spilling to disk); a lost executor's blocks
    are recomputed from lineage. ``checkpoint``: written to the shared
    checkpoint directory and the lineage is cut, so a lost executor costs a
    re-read instead of re-running the work before it (Spark deletes the files when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on). ``none``: as is.
    Cached results stay until :func:`release`.
    """
    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df
    if mode == "none":
        return df
    raise ValueError(f"unknown materialize mode {mode!r}")


# largest number of rows a broadcast hint is given for; beyond it the planner
# (and AQE, with runtime sizes) picks the join
BROADCAST_ROW_LIMIT = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when its proven row bound ``max_rows`` (derived
    from options, not from the data) is within ``limit``; otherwise return it
    unchanged for a shuffle join."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if max_rows <= limit else df


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table (a handful of rows made on the driver: settings, a
    bounded vocabulary) built from literals in the JVM, so no Python worker
    is started to deserialize it."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
