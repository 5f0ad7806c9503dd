"""Settings and the shared folder taken from the running session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "textfix") -> SparkSession:
    """Session for tests and single-machine timing."""
    parallel = "8" if cores == "*" else str(max(int(cores), 1))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Scratch folders of local applications without a shared folder, by application id.
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a scratch folder in local mode.

    The scratch folder is removed when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="textfix-")
        atexit.register(shutil.rmtree, _scratch[app], ignore_errors=True)
    return _scratch[app]


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread materializes inside the block once it is left.

    Whatever is derived from them has to be written by then.
    """
    outer, made = getattr(_open, "paths", None), []
    _open.paths = made
    try:
        yield
    finally:
        _open.paths = outer
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it exists."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: short lineage, known size, survives lost executors.

    The table stays until the caller removes it, unless it is made inside :func:`scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textfix/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters on it will not compute again.

    The optimizer moves a filter below a projection by repeating the projected expressions; it does
    not move one below ``explode``.
    """
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))
