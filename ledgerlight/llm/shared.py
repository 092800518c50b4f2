"""Helpers of the training-data operators: words, scratch tables, files in the shared folder, worker caches."""

from __future__ import annotations

import os
import pickle
import sys
import types
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import scratch_path

# Executors get the functions of this module with the job, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes for `df` to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`: what an operator adds beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, lineage cut, safe when executors go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The blank-separated words of a text; none for NULL."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` narrow rows, else as it is: then the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def local_path(uri: str) -> str:
    """Path of a folder on a mounted file system, as the workers that write and map plain files need it."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: binary files need a shared folder that is mounted as a path (file:/...)")
    return unquote(parts.path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for plain files in the shared folder."""
    path = local_path(scratch_path(spark, name))
    os.makedirs(path)
    return path


def ship(spark: SparkSession, thing):
    """Broadcast of an object of this package's classes, code included, for workers without the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def unship(sent):
    return pickle.loads(sent.value)


def text_parts(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose `text` has about `most` bytes together, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def worker_cache(name: str) -> dict:
    """A dict that a Python worker keeps across its tasks, until one of them asks for a dict of another name."""
    holder = sys.modules.setdefault("_ledgerlight_worker", types.ModuleType("_ledgerlight_worker"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.kept = name, {}
        pa.default_memory_pool().release_unused()
    return holder.kept
