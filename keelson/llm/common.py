"""What the operators of this folder share: column plumbing, the shared folder and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker holds as objects at a time; a longer row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def whole_text(name: str = "text") -> Column:
    """The text, a null being the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda that captures an expression would evaluate it for each element,
    also where the optimizer has moved the expression into it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='keelson-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, label: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df cut from its lineage: written as Parquet to the shared folder and read again.

    The folder goes when the driver ends. ``spent`` are earlier ones that nothing needs once this one is there; they go
    at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _hadoop(spark, path)
    files.deleteOnExit(place)
    for old in spent:
        files.delete(_hadoop(spark, old.scratch)[1], True)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most SLICE_ROWS rows and about SLICE_BYTES."""
    at = 0
    while at < batch.num_rows:
        n = min(SLICE_ROWS, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).get_total_buffer_size() > SLICE_BYTES and batch.slice(at, n).nbytes > SLICE_BYTES:
            n = (n + 1) // 2
        yield batch.slice(at, n)
        at += n


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[list[dict]], pa.Table | pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over slices of bounded rows and bytes.

    ``make`` runs once in a worker for each task and returns the function that turns a slice, a dictionary of
    Python lists by column, into a dictionary of columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from map(step, slices(batch))

    return df.mapInArrow(run, schema)
