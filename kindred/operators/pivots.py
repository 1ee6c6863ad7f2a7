"""Blocks of unit vectors around pivots, and which of them a vector can rule out.

A pivot is a vector of the table, drawn by hash; every vector belongs to the block of its nearest pivot.  Distances obey
the triangle inequality, so a block whose radius is less than its pivot's distance minus a bound holds nothing within
that bound.  Pivots are at most ``MOST`` a group, which is what travels with the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

MOST = 1_024


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of an Arrow column as rows of unit length (a vector of zeros stays)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-12)[:, None]


def pivot_count(n: int, block: int) -> int:
    """Pivots for n vectors: as many as keep blocks near half of ``block``, more where there are many vectors."""
    return 1 if n <= block else min(MOST, max(2, -(-2 * n // block), round(n**0.5 / 4)))


def pivots_of(vectors: DataFrame, n: int, count: int, id_col: str = "entity_id") -> dict[str, np.ndarray]:
    """``count`` pivots of each group of ``vectors(grp, id, vec)`` at most, by hash, on the driver."""
    groups = max(1, vectors.select("grp").distinct().count())
    steps = 1 << 40
    share = min(1.0, 4.0 * count * groups / max(1, n))
    drawn = vectors.withColumn("_h", F.pmod(F.xxhash64(id_col, F.lit("pivot")), F.lit(steps))).filter(F.col("_h") <= int(share * steps))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("_h", id_col))
    rows = drawn.select("grp", "vec", place.alias("_k")).filter(F.col("_k") <= count).select("grp", "vec").toArrow()
    found: dict[str, list] = {}
    for grp, row in zip(rows.column("grp").to_pylist(), unit_rows(rows.column("vec")) if rows.num_rows else []):
        found.setdefault(grp, []).append(row)
    return {g: np.array(x) for g, x in found.items()}


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors to pivots (vectors of zeros included)."""
    square = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def with_distances(vectors: DataFrame, pivots: dict[str, np.ndarray], nearest: bool) -> DataFrame:
    """``vectors`` with the nearest pivot as ``_block`` and its distance ``_dist``, or all distances as ``_to``.

    Groups without a pivot (too few vectors were drawn) are one block of their own, with no bound.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    new = [StructField("_block", IntegerType()), StructField("_dist", DoubleType())] if nearest else [StructField("_to", ArrayType(DoubleType()))]

    def measured(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, groups = unit_rows(batch.column("vec")), np.array(batch.column("grp").to_pylist(), object)
            block, dist, to = np.zeros(len(rows), np.int32), np.zeros(len(rows)), [None] * len(rows)
            for grp in set(groups.tolist()):
                own = np.flatnonzero(groups == grp)
                if grp not in shared.value:
                    dist[own] = 2.0
                    for r in own.tolist():
                        to[r] = [0.0]
                    continue
                d = distances(rows[own], shared.value[grp])
                block[own] = d.argmin(axis=1)
                dist[own] = d.min(axis=1)
                if not nearest:
                    for r, x in zip(own.tolist(), d):
                        to[r] = x
            extra = [pa.array(block), pa.array(dist)] if nearest else [pa.array(to, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *(f.name for f in new)])

    return vectors.mapInArrow(measured, StructType([*vectors.schema.fields, *new]))


def bound_of(similarity):
    """The distance of unit vectors of a cosine (a Column), a rounded one's step and the arithmetic's error included."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (similarity - 1e-6))) + 1e-7


def spread(spark: SparkSession, rows: int, most: int) -> int:
    return max(1, -(-rows // most))
