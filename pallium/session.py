"""Session helpers: a local session for tests and benchmarks, table loading,
the checkpoint folder and spreading of text rows over tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pallium",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use;
    ``conf`` adds or overrides settings."""
    builder = SparkSession.builder
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python keeps the last of duplicate JSON keys; so does the variant parser
        # with this setting (used by the strict answer check).
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only if none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only a local-mode session without the setting (tests) gets a fresh
    folder under the temp directory; a cluster session without it is an error,
    since a machine-local folder does not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:
        # No driver-side context (a remote session): the server's
        # spark.checkpoint.dir applies.
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this job")
    path = tempfile.mkdtemp(prefix="pallium-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def pinned(df: DataFrame, pins: list[DataFrame | str] | None = None) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read from there;
    ``pins`` collects it for :func:`release`."""
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    if pins is not None:
        pins.append(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pallium-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(pins: list[DataFrame | str], spark: SparkSession | None = None) -> None:
    """Remove the checkpoint files of pinned frames, and folders. Nothing made
    from them may be computed afterwards."""
    for pin in pins:
        if isinstance(pin, str):
            remove(spark or SparkSession.active(), pin)
            continue
        file = pin._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(pin.sparkSession, file.get())
    pins.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _cores(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # no driver-side context (e.g. a remote session)
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _planned_bytes(df: DataFrame) -> int:
    """Size that the optimizer estimates for the rows (planning only)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # a remote session: no plan at hand
        return 0


def _bytes_of(size: str) -> int:
    """A byte setting as a number: plain, or with a unit like ``128MB``."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def spread(df: DataFrame, key: str | None = None, factor: int = 3) -> DataFrame:
    """Spread rows over tasks when the source cannot occupy the cluster.

    Text work (regex) costs far more per byte than a shuffle, and a small
    source gives few splits. The test is on bytes: with at least ``factor``
    full splits per core, the scan's own splits carry the parallelism and no
    shuffle is paid (the case at scale); otherwise the rows are hash-partitioned
    on ``key`` (deterministic on retry, no local sort), or dealt round-robin
    without one. Runs no job and lists no files.
    """
    spark = df.sparkSession
    target = _cores(spark) * factor
    if _planned_bytes(df) >= target * _bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB")):
        return df
    if key is not None:
        return df.repartition(target, key)
    return df.repartition(target)
