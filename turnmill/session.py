"""Session helpers: the shared folder, tables that cut lineage, and broadcasts behind a size check."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond, the callers take a shuffled join.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_folders: dict[str, SparkSession] = {}
_temporary: str | None = None


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a temporary one is taken for the whole process; on a cluster it must be set."""
    global _temporary
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _temporary = _temporary or "file://" + tempfile.mkdtemp(prefix="turnmill-")
    return _temporary


def folder_of(spark: SparkSession) -> str:
    """A new folder within the shared one. Removed when the application ends."""
    folder = f"{shared_dir(spark)}/turnmill-{uuid.uuid4().hex}"
    _folders[folder] = spark
    return folder


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors, is read by column (and by the values of ``by``, in folders of their own). Removed when the application ends."""
    spark = df.sparkSession
    folder = folder_of(spark)
    to = df.write.mode("overwrite").option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def clear() -> None:
    """Removes the tables written so far. Results that read them must be consumed before."""
    for folder, spark in list(_folders.items()):
        try:
            jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
        _folders.pop(folder, None)


atexit.register(clear)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows of ``size`` bytes in all (measured first), else df itself."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    one = sum(wide, F.lit(8 * max(1, len(df.columns) - len(wide))))
    n, b = df.limit(rows + 1).select(one.alias("_b")).agg(F.count("*"), F.coalesce(F.sum("_b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and b <= size else df


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python workers can import it."""
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_turnmill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="turnmill-ship-"), "turnmill")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._turnmill_shipped = True
