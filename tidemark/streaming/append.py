"""Appending a stream of points to a store of encoded blocks.

Each micro-batch becomes blocks of its own with their own references, so encoding needs no state across batches.
Late points form further blocks of their day; readers order by time, so nothing is rewritten. Columns of the stored
blocks that are not the stream's own begin with ``tidemark_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.codec import decode_over, encode_over, is_float
from tidemark.operators.timeindex import with_block

BLOCK, REF, ENCODED = "tidemark_block", "tidemark_ref", "tidemark_encoded"
#: In place of REF and ENCODED where the tag holds floats, which are stored as places of doubles; batches of earlier versions lie beside them as they are.
PLACE_REF, PLACES = "tidemark_place_ref", "tidemark_places"


def encode_batch(batch: DataFrame, ts: str, box: list[str], tag: str) -> DataFrame:
    """Adds the block, the reference (minimum of box and block in this batch) and the encoded tag."""
    blocked = with_block(batch, ts, name=BLOCK)
    part = Window.partitionBy(*box, BLOCK).orderBy(ts)
    kind = batch.schema[tag].dataType
    ref, encoded = encode_over(F.col(f"`{tag}`"), kind, "m", part)
    return blocked.withColumns({PLACE_REF: ref, PLACES: encoded} if is_float(kind) else {REF: ref, ENCODED: encoded})


def append_stream(stream: DataFrame, path: str, checkpoint: str, ts: str, box: list[str], tag: str) -> StreamingQuery:
    """Starts a query that appends encoded blocks under ``path``, once per available input, and then ends.

    A batch that is replayed after a failure overwrites its own folder, so every point is stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        encode_batch(batch, ts, box, tag).drop(tag).write.mode("overwrite").parquet(f"{path}/tidemark_batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark, path: str, tag: str) -> DataFrame:
    """All points with the tag decoded; integers of fewer than 8 bytes come back as long, floats as double."""
    rows, part = spark.read.option("mergeSchema", True).parquet(path), Window.partitionBy(BLOCK).orderBy(BLOCK)
    values = [
        decode_over(F.col(encoded), F.col(ref), rows.schema[encoded].dataType, "m", part, encoded == PLACES)
        for ref, encoded in ((PLACE_REF, PLACES), (REF, ENCODED)) if encoded in rows.columns
    ]
    return rows.withColumn(tag, F.coalesce(*values)).drop(ENCODED, REF, PLACES, PLACE_REF, BLOCK, "tidemark_batch")
