"""Session helpers: tables, and intermediate results that outlive executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as written."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as named in spark.checkpoint.dir.

    Where the setting is missing a local session gets a temporary folder; a
    cluster is refused, since executors don't see each other's disks.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="heliograph-")
    return _LOCAL[app]


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """What is planned and run here has these settings."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """What runs here loses its shuffle files as it ends, not when the driver happens to collect its garbage."""
    return configured(spark, {_CLEANUP: "true"})


def batches(spark: SparkSession, rows: int):
    """What is planned and run here reads Parquet, and sends to Python, so many rows at once."""
    return configured(spark, {k: str(rows) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")})


#: How rows of megabytes are written: by default a page and a row group hold 100 rows before their size is looked at.
WIDE = {"parquet.block.size": 8 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """df, computed once, written to the shared folder and read again.

    Lost executors cost only the tasks that ran on them, and the plan that
    follows starts at a scan. Its shuffle files go with the write. options: of
    the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes what `staged` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
