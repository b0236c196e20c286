"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python (a longer row is a batch of its own): whole texts differ a lot in length.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on, this session's Arrow batches are bounded in bytes, unless it has a smaller bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not (now[:-1].isdigit() and now[-1] == "b" or now.isdigit()) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and Spark runs on this machine alone (tests), a new temporary folder becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    bounded_batches(spark)
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def clear_scratch(spark: SparkSession, keep: list[str]) -> None:
    """Deletes all tables made below the shared folder so far but those in keep. What still reads them fails then."""
    for path in [x for x in _scratch if x not in keep]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _scratch.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo of. A null id counts as the empty text, so it gets a fold too."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(of)


def byte_values(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; nulls are empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(sizes: list[int], most: int = 4_000_000):
    """Ranges of rows whose sizes add up to at most `most`, or single larger rows."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
