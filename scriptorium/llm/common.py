"""Helpers that the operators share: shared-folder tables, fold columns, Arrow text."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may do without the setting, with a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.scriptorium.shared.dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="scriptorium-")
            spark.conf.set("spark.scriptorium.shared.dir", found)
    return found.rstrip("/")


#: Tables that `materialise` has written, for `Scratch`.
_WRITTEN: list[DataFrame] = []


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` into the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    _WRITTEN.append(out)
    return out


class Scratch:
    """Deletes the tables written within it, but for those kept, when it ends."""

    def __enter__(self) -> Scratch:
        self.start, self.kept = len(_WRITTEN), []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_) -> None:
        for t in _WRITTEN[self.start :]:
            if not any(t is k for k in self.kept):
                discard(t)
        del _WRITTEN[self.start :]


def discard(df: DataFrame | None) -> None:
    """Delete a table written by `materialise` that no later plan reads."""
    path = getattr(df, "_scriptorium_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds in a Python worker, in rows and, but for its last row, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def parts(n_rows: int, per: int) -> int:
    return max(1, math.ceil(n_rows / per))


#: Tasks that count into tables of their own, at most, however many partitions the input has.
COUNTERS = 2048


def sum_arrays(df: DataFrame, count, n_values: int, dtype: str = "<i8", chunk: int = 65536) -> np.ndarray:
    """Add up the fixed-size integer arrays that `count` makes of the partitions of `df`, as (chunk int, body binary).

    At most COUNTERS tasks count, so that what is shuffled is bounded too. The sums stream: a task holds one array for each of its chunks. The sum has `n_values` entries whatever the input's size, so collecting it is bounded."""
    df = df.coalesce(COUNTERS).mapInArrow(count, "chunk int, body binary")

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
                x = np.frombuffer(body, "<i8")
                totals[k] = totals[k] + x if k in totals else x
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(totals), pa.int32()), "body": pa.array([x.tobytes() for x in totals.values()], pa.binary())})

    out = np.zeros(n_values, dtype)
    for row in df.repartition("chunk").mapInArrow(add, "chunk int, body binary").collect():
        x = np.frombuffer(row["body"], "<i8")
        out[row["chunk"] * chunk : row["chunk"] * chunk + len(x)] = x
    return out


def chunks_of(total: np.ndarray, chunk: int = 65536, together: int = 8):
    """The non-zero chunks of one task's integer array, for `sum_arrays`, a few in each batch."""
    flat = total.ravel().astype("<i8", copy=False)
    keep = [k for k in range(0, len(flat), chunk) if flat[k : k + chunk].any()]
    for i in range(0, len(keep), together):
        some = keep[i : i + together]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // chunk for k in some], pa.int32()), "body": pa.array([flat[k : k + chunk].tobytes() for k in some], pa.binary())})
