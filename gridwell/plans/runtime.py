"""Shared-folder, table and size-check helpers."""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows and bytes up to which a side of a join may be broadcast after both have been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Rows and bytes of the record batches that go to Python workers: whole documents may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep record batches small, unless the session already asks for smaller ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this process's memory pools keep of tables that are gone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(rows):
    """rows, a generator function for mapInArrow, that gives memory back when it ends: a worker stays for later tasks."""

    @functools.wraps(rows)
    def run(*args):
        yield from rows(*args)
        give_back()

    return run


class Kinds:
    """The rows of one part as batches, kind by kind as they come."""

    def __init__(self, group):
        self.group, self.ahead = group, next(group, None)

    def of(self, kind: int):
        while self.ahead is not None and self.ahead[1] == kind:
            yield self.ahead[2]
            self.ahead = next(self.group, None)


def by_kind(batches):
    """(part, Kinds) of batches that are sorted by their columns part and kind. A part is to be used up before the next."""

    def slices():
        for batch in batches:
            part, kind = (batch.column(c).to_numpy() for c in ("part", "kind"))
            cuts = (np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist()
            for a, z in zip([0, *cuts], [*cuts, len(part)]):
                if z > a:
                    yield int(part[a]), int(kind[a]), batch.slice(a, z - a)

    for part, group in itertools.groupby(slices(), lambda x: x[0]):
        yield part, Kinds(group)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset."""
    bound_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='gridwell-')}"
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_gridwell"
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, compression: str | None = None, level: int = 3) -> DataFrame:
    """Write as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("parquet.compression.codec.zstd.level", level).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """Write as an external Parquet table in the shared folder, in as many buckets of `key` as there are shuffle
    partitions, and read it again: operators that group by the key then need no shuffle of it."""
    spark = df.sparkSession
    table_name = f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), key).option("path", f"{shared_dir(spark).rstrip('/')}/{table_name}").option("compression", "zstd").format("parquet").saveAsTable(table_name)
    return spark.table(table_name)


def name(column: str) -> str:
    """A column's name as SQL, whatever is in it."""
    return "`" + column.replace("`", "``") + "`"


def quoted(column: str) -> Column:
    return F.col(name(column))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _width(column: str, kind: T.DataType) -> Column:
    """About the bytes that a column's value takes in a row."""
    col = quoted(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
        return F.greatest(F.size(col), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)).cast("long") * 2 + 24
    return F.lit(16).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows and `max_bytes` bytes, both counted; unchanged otherwise."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    rows, size = df.select(width.alias("width")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= max_bytes else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str:
    """The bare path of a file: URI; other URIs stay."""
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def makedirs(uri: str) -> None:
    if local_path(uri).startswith("/"):
        os.makedirs(local_path(uri), exist_ok=True)
