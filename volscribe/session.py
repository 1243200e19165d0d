"""Session settings, working folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Memory of one row beside its values: row header, hash-map slot, pointers.
ROW_OVERHEAD_BYTES = 48

_local_root: str | None = None
_shipped: set[str] = set()
_made: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every job here relies on and ship this package."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def build_session(app: str = "volscribe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return configure(builder.getOrCreate())


def work_folder(spark: SparkSession, label: str = "stage") -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may do without that setting; a cluster needs a folder
    that every executor sees, so there the setting is required.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="run-")
        root = "file://" + _local_root
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def remove_work(spark: SparkSession) -> int:
    """Delete the folders made since the last call, once no result reads them any more; their number."""
    configuration, removed = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += folder.getFileSystem(configuration).delete(folder, True)
    return removed


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of ``df``, from one aggregate over its columns."""
    parts = [str(ROW_OVERHEAD_BYTES)]
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(f"coalesce(octet_length(`{field.name}`), 0)")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            parts.append(f"coalesce(cardinality(`{field.name}`), 0) * 8")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"cannot size column {field.name}")
        else:
            parts.append("8")
    return int(df.agg(F.expr(f"coalesce(sum(cast({' + '.join(parts)} AS bigint)), 0)")).first()[0])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint when the measured size allows it, else ``df`` unchanged.

    Unhinted, the join shuffles and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
