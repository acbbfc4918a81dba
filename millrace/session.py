"""Session factory and the shared scratch area."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "millrace", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: below ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset (local tests) a temporary folder takes its place; on a cluster a machine-local
    folder would be invisible to the other executors, so that case raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


_roots: set[str] = set()


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the JVM may be gone already; local folders can still go
        if root.startswith(("/", "file:")):
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def swept(spark: SparkSession) -> str:
    """The scratch area, which is removed when the driver exits."""
    root = scratch_root(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_sweep, spark, root)
    return root


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared scratch area and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{swept(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, so that they need no installation."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path("millrace") / p.relative_to(top)))
    sc.addPyFile(str(zipped))
    atexit.register(shutil.rmtree, zipped.parent, True)


#: Bytes of an Arrow batch: with long texts a batch of the default size is a multiple of it in a worker's copies.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package available to the workers, in batches of BATCH_BYTES unless the session sets another
    size than Spark's own."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)
