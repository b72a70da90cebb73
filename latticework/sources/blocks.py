"""Text read by byte range in reading order, with a state carried from block to block.

A block is one split of a file. A first scan turns each block into a small summary of what it does to the state of its
reader; summaries are combined along the file, and a second scan parses each block from its own entry state. Text never
moves between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of one row per block are broadcast up to this many rows (some 200 bytes each) and joined by shuffle beyond.
BROADCAST_BLOCKS = 200_000


def pieces(spark: SparkSession, path: str | list[str], recursive: bool = False, separator: str | None = None) -> DataFrame:
    """(file, block, size, unit, ord, value): lines, or pieces up to a separator, in reading order within a block."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = (reader.option("lineSep", separator) if separator else reader).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.col("_metadata.file_size").alias("size"), "value", F.monotonically_increasing_id().alias("ord"))
    return lines.withColumn("unit", F.xxhash64("file", "block"))


def looked_up(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a table of one row per block, broadcast where it is small."""
    return rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, keys)


def with_state(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows with the state at the start of their block, still in reading order."""
    found = looked_up(rows, states, ["unit"])
    if states.count() > BROADCAST_BLOCKS:  # the join has lost the order
        found = found.repartition("unit").sortWithinPartitions("unit", "ord")
    return found


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(first of its unit, rows of one unit), batch by batch."""
    last = None
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                yield bool(a or unit[a] != last), batch.slice(a, b - a)
                last = unit[a]
