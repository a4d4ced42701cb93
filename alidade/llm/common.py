"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one
    stands in only where driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_alidade_dir", None)
        if at is None:
            at = "file://" + tempfile.mkdtemp(prefix="alidade-")
            spark._alidade_dir = at
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there,
    so a lost executor costs one task and not the whole plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/alidade/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_rows(column: pa.Array | pa.ChunkedArray):
    """Each value's UTF-8 bytes, b"" for null, without decoding."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


def slices(sizes, most: int):
    """(start, end) of runs of rows that hold about ``most`` bytes each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def long_id(df: DataFrame, name: str = "doc_id"):
    """The id column as a long."""
    return F.col(name) if isinstance(df.schema[name].dataType, LongType) else F.col(name).cast("long")


def prefix_scan(values, kind: str, zero, op):
    """Native: for an array column, the array that holds at each place ``op``
    over all values before it, from ``zero``.

    Two levels of blocks of 256, so an array of n costs about 256 n copies and
    not n squared.
    """
    block = 256
    blocks = F.when(
        F.size(values) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
            lambda b: F.slice(values, b * block + 1, block),
        ),
    ).otherwise(F.array().cast(f"array<array<{kind}>>"))

    def running(part, start):
        return F.aggregate(
            part,
            F.struct(F.array().cast(f"array<{kind}>").alias("out"), start.cast(kind).alias("at")),
            lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), op(acc["at"], x).alias("at")),
        )["out"]

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero).cast(kind), op))
    starts = running(totals, F.lit(zero))
    return F.flatten(F.zip_with(blocks, starts, running))


def prefix_sums(lengths):
    """Exclusive running sums of an array of longs."""
    return prefix_scan(lengths, "bigint", 0, lambda s, x: s + x)


def prefix_max(values):
    """The largest of the values before each place of an array of longs from 0 up."""
    return prefix_scan(values, "bigint", 0, lambda s, x: F.greatest(s, x))
