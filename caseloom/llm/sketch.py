"""A bounded sketch of how many rows hold each hashed item, summed over all rows by Spark."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS, SLICES, FAN_IN = 1 << 22, 16, 64


def cell_of(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(CELLS - 1)).astype(np.intp)


def document_frequencies(texts: DataFrame, items, column: str = "text") -> np.ndarray:
    """For each of ``CELLS`` cells the number of (row, distinct item) pairs that fall into it, as uint32.

    ``items`` maps a text to its distinct hashed items. Every task sends one compressed
    array of ``CELLS`` counts; arrays are added up in steps of ``FAN_IN``, slice by slice, so no
    task and not the driver holds more than a fixed amount, however many rows there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for text in batch.column(column).to_pylist():
                np.add.at(cells, cell_of(items(text)), np.uint32(1))  # Of the array's type: many times as fast.
        parts = np.split(cells, SLICES)
        sums = pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())
        task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), task, sums], ["slice", "part", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // SLICES, np.uint64)
        for sums in group["sums"]:
            total += np.frombuffer(zlib.decompress(sums), np.uint32)
        capped = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN, "sums": [zlib.compress(capped.tobytes(), 1)]})

    schema = "slice long, part long, sums binary"
    sums, left = texts.select(column).mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("step")).applyInPandas(add, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    rows = sums.select("slice", "sums").collect()  # SLICES rows of a fixed size.
    out = np.zeros(CELLS, np.uint32)
    for r in rows:
        out[r["slice"] * (CELLS // SLICES) : (r["slice"] + 1) * (CELLS // SLICES)] = np.frombuffer(zlib.decompress(r["sums"]), np.uint32)
    return out
