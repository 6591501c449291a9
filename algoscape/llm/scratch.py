"""Tables in the folder that the whole cluster shares, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch. A column's buffer is up to twice that, once as vector and once as message, outside the heap;
#: a buffer of more than 4 MB that is freed makes the C library keep as much again in the arena of every thread.
BATCH_BYTES = 2 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="algoscape-shared-")
    return _own[app]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers hold at most ``BATCH_BYTES`` (or one row), however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def refuse(df: DataFrame, *names: str) -> None:
    """Raise an error where a table has columns that an operator adds."""
    clash = {x.lower() for x in names} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns that the operator adds: {sorted(clash)}")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of a shared folder; None where there is none."""
    at, files = _file(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file of a shared folder: readers find the old or the new one whole."""
    at, files = _file(spark, path)
    made, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(made)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(at, False)
    files.rename(made, at)


class Scratch:
    """Written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.base = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, sort: list[str] | None = None, files: int | None = None) -> DataFrame:
        """Write a table, to at most ``files`` files if given, and read it again: later jobs start from the files."""
        if files is not None:
            df = df.coalesce(files)
        if sort:
            df = df.sortWithinPartitions(*sort)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later job reads."""
        at, files = _file(self.spark, self.path(name))
        files.delete(at, True)

    def clear(self) -> None:
        """Remove all tables."""
        at, files = _file(self.spark, self.base)
        files.delete(at, True)
