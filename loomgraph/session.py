"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Session settings every plan of this library is written for.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application: they need not have it on their path."""
    app, root = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _shipped or not root.is_dir():
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="loomgraph-py-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores before work that is heavy a row: moved only where its input has fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` where it is set.

    Only a local master may fall back to a temporary folder; on a cluster such
    a folder would be lost with its machine, so there the setting is required.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.environ.setdefault("LOOMGRAPH_LOCAL_DIR", tempfile.mkdtemp(prefix="loomgraph-"))
    return f"file://{folder}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, gone when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


#: Shuffle files go as soon as what they made is written; else they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps columns apart, so each reader
    loads only what it uses. Survives the loss of executors. The files go away
    when the driver ends, or with ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        fresh = df.select("*")  # planned under this setting
        fresh.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def release(*stages: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``stages``; nothing that is still to be run may read them."""
    for df in stages:
        _forget(df.sparkSession, df._materialized)
