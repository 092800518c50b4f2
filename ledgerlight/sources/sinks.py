"""Sinks: full reload, append, upsert and insert-ignore on Parquet tables.

A write puts its rows into a new folder and then adds one file to the table's log: the version and
all folders that make it up. Nothing that a version names is ever changed, so a reader keeps the
version it began with, and what a failed or repeated attempt left behind is in no version. The file is
named by the version and appears whole or not at all, and only if there is none of that name: of two
writers of one version the first has it and the other is told. That takes a file system whose renames
are atomic (HDFS, a mounted path).
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ledgerlight.operators.merge import insert_ignore, keep_first, upsert_rows

LOG = "version long, columns string, keys array<string>, folders array<string>"
BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer committed the same version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _current(self) -> Row | None:
        """The newest version."""
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return log.orderBy(F.desc("version")).first()

    def exists(self) -> bool:
        return self._current() is not None

    def _rows(self, columns: str, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(columns))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            raise FileNotFoundError(self.path)
        return self._rows(current["columns"], current["folders"])

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, keys: list[str]) -> list[str]:
        """The rows in a folder of their own; with `keys`, one folder per bucket of keys."""
        folder = f"data/{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.path}/{folder}")
            return [folder]
        df.withColumn("_bucket", self._bucket(keys)).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(StructType([*df.schema.fields]).add("_bucket", IntegerType())).parquet(f"{self.path}/{folder}")
        return [f"{folder}/_bucket={r['_bucket']}" for r in written.select("_bucket").distinct().collect()]

    def _commit(self, before: Row | None, schema: StructType, keys: list[str], folders: list[str]) -> None:
        version = before["version"] + 1 if before else 1
        line = {"version": version, "columns": json.dumps(schema.jsonValue()), "keys": keys, "folders": folders}
        if not self._publish(f"{self.path}/log", f"{version:020d}.json", json.dumps(line) + "\n"):
            raise ConcurrentWrite(f"{self.path} version {version}")

    def _publish(self, folder: str, name: str, text: str) -> bool:
        """A new file with this text; False if there is one of that name. Half-written files have names that readers skip."""
        hidden = f"_{uuid.uuid4().hex}"
        where = urlparse(folder)
        if where.scheme in ("", "file"):
            local = unquote(where.path)
            os.makedirs(local, exist_ok=True)
            with open(os.path.join(local, hidden), "w", encoding="utf-8") as file:
                file.write(text)
            try:
                os.link(os.path.join(local, hidden), os.path.join(local, name))
            except FileExistsError:
                return False
            finally:
                os.unlink(os.path.join(local, hidden))
            return True
        fs = self.spark._jvm.org.apache.hadoop.fs
        path, conf = fs.Path(f"{folder}/{hidden}"), self.spark._jsc.hadoopConfiguration()
        stream = path.getFileSystem(conf).create(path, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:  # unlike that of FileSystem, this rename never replaces a file
            fs.FileContext.getFileContext(path.toUri(), conf).rename(path, fs.Path(f"{folder}/{name}"), self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            path.getFileSystem(conf).delete(path, False)
            return False
        return True

    def replace(self, df: DataFrame) -> None:
        """Truncate and reload. Like every write: ConcurrentWrite if another writer committed since it began."""
        before = self._current()
        self._commit(before, df.schema, [], self._write(df, []))

    def append(self, df: DataFrame) -> None:
        """A version with more rows; columns that either side lacks are NULL."""
        before = self._current()
        if before is None:
            return self.replace(df)
        schema = StructType.fromJson(json.loads(before["columns"]))
        added = [f for f in df.schema.fields if f.name not in schema.fieldNames()]
        same = df.select(*[F.col(f.name).cast(schema[f.name].dataType if f.name in schema.fieldNames() else f.dataType) for f in df.schema.fields])
        folders = self._write(same, before["keys"])
        self._commit(before, StructType(schema.fields + added), before["keys"], before["folders"] + folders)

    def upsert(self, updates: DataFrame, keys: list[str], order: list[Column] | None = None) -> None:
        """Rows of `updates` replace or extend the table by key; NULL keys match nothing.

        Of several updates of a key the first in `order` counts, by default that with the largest
        values. The first upsert deals the table into buckets of keys; later ones rewrite those buckets
        only that have updates.
        """
        before = self._current()
        updates = keep_first(updates, keys, order or [F.desc(c) for c in updates.columns if c not in keys] or [F.lit(1)])
        if before is None:
            return self._commit(None, updates.schema, keys, self._write(updates, keys))
        touched, kept = before["folders"], []
        if before["keys"] == keys:
            hit = {f"_bucket={r['b']}" for r in updates.select(self._bucket(keys).alias("b")).distinct().collect()}
            touched = [f for f in before["folders"] if f.rsplit("/", 1)[1] in hit]
            kept = [f for f in before["folders"] if f.rsplit("/", 1)[1] not in hit]
        merged = upsert_rows(self._rows(before["columns"], touched), updates, keys)
        self._commit(before, merged.schema, keys, kept + self._write(merged, keys))

    def insert_ignore(self, rows: DataFrame, keys: list[str]) -> None:
        self.append(insert_ignore(self.read(), rows, keys) if self.exists() else rows.dropDuplicates(keys))


def write_scores(
    scores: VersionedTable, fresh: DataFrame, rescore_all: bool = False, reports: VersionedTable | None = None
) -> None:
    """Append the scores of trades not scored yet; a full rescore replaces them and empties the reports."""
    if not rescore_all:
        scores.append(fresh)
        return
    if reports is not None and reports.exists():
        reports.replace(reports.read().limit(0))
    scores.replace(fresh)


def write_matrix(df: DataFrame, path: str) -> None:
    """Feature matrices and cleaned tables."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
