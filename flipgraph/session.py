"""Session factory and the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flipgraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset on a local master, as in tests, one of our own.

    On a cluster it must be set: a folder of one machine is not seen by the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else ""
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="flipgraph-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def hadoop_path(spark: SparkSession, uri: str):
    """(FileSystem, Path) of an address in any file system that Hadoop knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, what: str) -> str:
    """An address for a table in the shared folder; it is deleted when the driver ends."""
    uri = f"{shared_dir(spark)}/flipgraph-{what}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, path = hadoop_path(spark, uri)
            fs.delete(path, True)
        except Exception:  # the session may be gone
            pass

    atexit.register(drop)
    return uri


def cut(df: DataFrame, what: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends, and a lost executor costs nothing."""
    uri = new_folder(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors: a zip of it in the shared folder, once per application.

    Needed where executors have no copy of the repository; harmless where they have.
    """
    context = spark.sparkContext
    if getattr(context, "_flipgraph_shipped", False):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    uri = f"{new_folder(spark, 'code')}/flipgraph.zip"
    fs, path = hadoop_path(spark, uri)
    out = fs.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(uri)
    context._flipgraph_shipped = True
