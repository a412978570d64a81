"""Helpers that every training-data operator shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.ship import ship

#: Upper bound on rows and bytes of one Arrow batch; texts can be long, so batches stay short.
#: Each batch is held several times outside the heap, in the JVM and in the worker.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20
#: Parquet options for rows of some MB each, which else share one page and row group up to a hundred.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(8 << 20)}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the master is local (single-machine tests) a temporary folder is made
    and set; elsewhere an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = held or "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        if not held:
            spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared folder and read it back.

    This cuts the lineage with a replica that survives lost executors.  The
    files go when the driver ends.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cl_path = path
    return out


def stored(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again.

    The driver's garbage collection lets Spark delete the shuffle files of
    finished steps, which else stay until memory runs short.
    """
    for t in tables:
        spark, path = t.sparkSession, t._cl_path
        _written.remove((spark, path))
        _delete(spark, path)
    if tables:
        spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has already ended
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Python workers with the package, and short Arrow batches, so that long texts fit in one."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def utf8(column: str = "text"):
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, sorted; by sorting, which is faster than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def free_prefix(columns: list[str], base: str = "cl_") -> str:
    """``base``, longer by as many underscores as it takes to begin none of ``columns``."""
    while any(c.lower().startswith(base) for c in columns):
        base += "_"
    return base
