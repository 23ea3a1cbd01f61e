"""Session factory and the shared-folder helpers that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "lexloom", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; any of them can be overridden."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Named by the cluster in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is used on a local master, as in tests;
    on several machines that is an error, since data in such a folder would be lost.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written/{spark.sparkContext.applicationId}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the plan that made it, so it survives the loss of executors,
    and is columnar and compressed, unlike a checkpointed RDD. See :func:`discard_written`.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Within it, what is run sends rows to Python in batches of about ``size``, so that a long text is in no batch with many others."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def discard_written(spark: SparkSession) -> None:
    """Delete all that :func:`written` wrote for this application. Results not yet stored elsewhere that depend on it are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, so that executors need no installation."""
    context = spark.sparkContext
    if getattr(context, "_lexloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lexloom_shipped = True
