"""All pairs of two sides, met in cells: a cell has a block of programmes and a
block of jobs, and only what its kernel yields leaves it.

A side has at most PROGRAMME_BLOCKS or JOB_BLOCKS blocks, so a row is copied to
a fixed number of cells at most and what is shuffled grows as the input does; a
cell holds its two blocks and SCORES scores at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROGRAMME_BLOCKS, JOB_BLOCKS = 48, 12
#: Fewer rows than this need no further block.
LEAST = 512
#: Scores that a kernel holds at a time (8 bytes each).
SCORES = 2_000_000
#: Half a unit of the ninth digit either way, and more: scores this close may be equal once rounded.
CLOSE = 2e-9


def blocks(n: int, most: int, least: int = LEAST) -> int:
    return max(1, min(most, -(-n // least)))


def floats(df: DataFrame, column: str):
    """The vectors as they are stored if they are float or double, else as double."""
    kind = df.schema[column].dataType
    native = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return F.col(column) if native else F.col(column).cast("array<double>")


def cells(programmes: DataFrame, jobs: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, extra: DataFrame | None = None, most: tuple[int, int] = (PROGRAMME_BLOCKS, JOB_BLOCKS)) -> DataFrame:
    """What ``kernel`` yields for each cell. Sides are (id, ...) with other
    columns alike; ``extra`` (programme_id, job_id, ...) goes to the cells of
    its pairs. The kernel gets batches with ``side`` 0, 1 and 2."""
    n, m = (blocks(df.count(), k) for df, k in zip((programmes, jobs), most))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    at = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k).cast("long")).cast("int")
    left = programmes.withColumn("side", F.lit(0)).withColumn("pb", at("id", n)).withColumn("jb", every(m))
    right = jobs.withColumn("side", F.lit(1)).withColumn("jb", at("id", m)).withColumn("pb", every(n))
    rows = left.unionByName(right, allowMissingColumns=True)
    if extra is not None:
        own = extra.withColumnsRenamed({"programme_id": "id", "job_id": "other"})
        rows = rows.unionByName(own.withColumn("side", F.lit(2)).withColumn("pb", at("id", n)).withColumn("jb", at("other", m)), allowMissingColumns=True)
    # one number for the cell, dealt to as many partitions as there are cells: a task has one cell or a few
    rows = rows.withColumn("cell", F.col("pb") * m + F.col("jb")).drop("pb", "jb").repartition(n * m, "cell")
    return rows.groupBy("cell").applyInArrow(_streamed(kernel), schema)


def _streamed(kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)

    return run


def of_side(table: pa.Table, side: int) -> pa.Table:
    return table.filter(pa.compute.equal(table["side"], side))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column without nulls, one a row."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def vectors(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, in order, and vectors of a side's rows that have one."""
    own = of_side(table, side)
    own = own.filter(pa.compute.is_valid(own["v"])).sort_by("id")
    return own["id"].to_numpy(), matrix(own["v"])


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))


def scored(x: np.ndarray, y: np.ndarray, cosine: bool, step: int | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of x with their dots and scores (cosines, or the dots) with all of y."""
    step = step or max(1, SCORES // max(1, len(y)))
    far = length(y)
    y = y.astype(np.float64)
    for a in range(0, len(x), step):
        part = x[a : a + step].astype(np.float64)
        dots = part @ y.T
        if cosine:
            scale = np.outer(length(part), far)
            score = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
        else:
            score = dots
        yield slice(a, a + len(part)), dots, score


def first_of_rows(score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores, rounded to 9 digits, of the ``top`` of each row
    by (score, column)."""
    width = score.shape[1]
    if width > top:
        bar = np.partition(score, width - top, axis=1)[:, width - top]
        rows, columns = np.nonzero(score >= bar[:, None] - CLOSE)
    else:
        rows, columns = (i.ravel() for i in np.indices(score.shape))
    value = np.round(score[rows, columns], 9)
    order = np.lexsort((columns, -value, rows))
    rows, columns, value = rows[order], columns[order], value[order]
    starts = np.searchsorted(rows, np.arange(len(score)))
    first = np.arange(len(rows)) - starts[rows] < top
    return rows[first], columns[first], value[first]


def batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
