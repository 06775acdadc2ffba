"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.store import checkpoint_dir, checkpointed, written

__all__ = ["checkpoint_dir", "checkpointed", "held_out", "map_batches", "table", "texts_in_pieces", "written"]

WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """Rows kept back from training: crc32 of the id's decimal text leaves 1 modulo 3; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_in_pieces(batch: pa.RecordBatch, column: str, most_chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about `most_chars` characters, so that a batch of very long texts never
    has all its working arrays in memory at once. Null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    first, run, chars = 0, [], 0
    for i in range(len(values)):
        t = values[i].as_py() or ""
        run.append(t)
        chars += len(t)
        if chars >= most_chars:
            yield first, run
            first, run, chars = i + 1, [], 0
    if run:
        yield first, run
