"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: texts may be long, and this bounds what a Python worker holds at once.
BATCH_ROWS = 500

_own: str | None = None  # of this process, where no shared folder is named
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary folder if driver and executors are one process, else ValueError."""
    global _own
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; clear() removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage is cut, sizes are known, and a lost executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df in four partitions a core, or an eighth of the shuffle partitions where that is more: what many small partitions hold becomes few files.
    A file on a local disk costs some chmod processes, forked off the executor with all its memory (127 for 40 files). Not for a stage with a shuffled
    hash join: a task keeps the tables of all partitions that it takes."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from rows of the driver, as Arrow: from a plain list executors would start a second set of Python workers for it."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of keys in some partitions for each core: a table of few bytes is read by few tasks, however much is to be computed for each of its rows."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def discard(table: DataFrame) -> None:
    """Removes a table that this process staged, once nothing that is still to be computed reads it."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        for name in [w for w in _written if f"/{w.rsplit('/', 1)[-1]}/" in file]:
            _written.remove(name)
            _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this process staged. Results that read them are gone, too: store them before."""
    while _written:
        _delete(spark, _written.pop())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while; what it was before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch for this session. It stays set: results are lazy and need it when they are read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
