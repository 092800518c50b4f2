"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.shared import scratch_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
TOP = 10
#: Buckets per doubling of the length, and vectors of a block: the part of a bucket that one task searches.
BUCKETS = 4
BLOCK = 4096
QUERIES = 1024
#: Blocks of the longest vectors, at most, that the first pass goes through to fill one block.
STARTING = 64
#: Coordinates that are looked at in a bucket where the cosine must be large, and how large that is.
FOCUS = 6
STEEP = 0.35
BLOCK_SCHEMA = "block long, bucket int, n int, ids binary, vectors binary, width int"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, length2): whole numbers floor(scale * x) of each component, and the squared length.

    Vectors that are NULL or hold a NULL or non-finite component are left out, as are those without an id.
    Components have to stay within 2^31 / scale and products within a long.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(double, lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    ).withColumn("length2", F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x * x))


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A block's vectors as one row, longest first."""
    width = max(len(v) for v in rows.column("v"))
    flat = np.zeros((rows.num_rows, width), np.int64)
    for i, v in enumerate(rows.column("v")):
        flat[i, : len(v)] = v.values.to_numpy()
    ids = rows.column("vec_id").to_numpy()
    order = np.lexsort((ids, -(flat * flat).sum(axis=1)))
    return pa.table({
        "block": pa.array([key[0].as_py()], pa.int64()), "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()),
        "n": pa.array([rows.num_rows], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
        "vectors": pa.array([flat[order].tobytes()], pa.binary()), "width": pa.array([width], pa.int32()),
    })


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors grouped by length: (block, bucket, n, ids, vectors, width), about `rows` vectors to a block.

    A bucket holds the vectors whose length lies in one of BUCKETS steps of a doubling. It is cut by a hash of
    the id into as many blocks as it needs, so vectors of one length, however many, are many tasks. The driver
    sees one number per bucket, of which 64-bit lengths allow few.
    """
    bucket = F.when(F.col("length2") > 0, F.floor(F.log2("length2") * (BUCKETS / 2))).otherwise(-1).cast("int")
    marked = vectors.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r["count"] for r in marked.groupBy("bucket").count().collect()}
    parts, first, at = {}, {}, 0
    for b in sorted(sizes, reverse=True):
        parts[b], first[b] = math.ceil(sizes[b] / rows), at
        at += parts[b]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], BLOCK_SCHEMA)
    # The numbers of few buckets: a map in the plan.
    pairs = [(F.lit(b), F.lit(parts[b]), F.lit(first[b])) for b in sizes]
    n = F.create_map(*[x for b, p, _ in pairs for x in (b, p)])
    start = F.create_map(*[x for b, _, f in pairs for x in (b, f)])
    block = F.element_at(start, F.col("bucket")) + F.pmod(F.xxhash64("vec_id"), F.element_at(n, F.col("bucket")))
    keyed = marked.select("vec_id", "v", "bucket", block.cast("long").alias("block"))
    return keyed.groupBy("block").applyInArrow(_pack, BLOCK_SCHEMA)


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["width"])


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of different widths: the missing components count as zero."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


class Bucket:
    """A block of vectors, longest first, with their lengths and directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = np.abs(vectors).max(initial=0) < 1 << 20 and vectors.shape[1] < 1 << 12  # products are whole doubles
        self.doubles = vectors.astype(np.float64)
        self.lengths = np.sqrt((self.doubles * self.doubles).sum(axis=1))
        safe = np.where(self.lengths > 0, self.lengths, 1)
        self.directions = np.ascontiguousarray((self.doubles / safe[:, None]).T)

    def candidates(self, query: np.ndarray, length: float, least: float) -> np.ndarray:
        """Rows that may score `least` or more.

        A score is the product of both lengths and the cosine, so a vector shorter than least/length is out: a
        prefix is left. If the cosine that the longest needs is large, it also bounds each coordinate of the
        direction: q*t -+ sqrt((1-q^2)(1-t^2)), which a few of the query's largest coordinates are tested on.
        """
        if least <= 0 or length == 0:
            return np.arange(len(self.ids) if least <= 0 else 0)
        slack = 1e-9
        kept = int(np.searchsorted(-self.lengths, -(least / length) * (1 - slack), "right"))
        if not kept:
            return np.arange(0)
        cosine = min(1.0, least / (length * self.lengths[0])) - slack
        if cosine < STEEP:
            return np.arange(kept)
        unit = query / length
        found = np.ones(kept, bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            q = float(unit[f])
            spread = math.sqrt(max(0.0, (1 - q * q) * (1 - cosine * cosine))) + slack
            low = q * cosine - spread if cosine >= -q else -1.0
            high = q * cosine + spread if cosine >= q else 1.0
            row = self.directions[f, :kept]
            found &= (row >= low - slack) & (row <= high + slack)
        return np.flatnonzero(found)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact and np.abs(query).max(initial=0) < 1 << 20:
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def best(self, query_id: int, query: np.ndarray, least: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the `top` best rows that score `least` or more, the query's own left out; ties to smaller ids."""
        rows = self.candidates(query.astype(np.float64), math.sqrt(float((query.astype(np.float64) ** 2).sum())), least)
        rows = rows[self.ids[rows] != query_id]
        score = self.scores(rows, query)
        kept = score >= least
        ids, score = self.ids[rows][kept], score[kept]
        if len(score) > top:
            kept = score >= np.partition(score, -top)[-top]
            ids, score = ids[kept], score[kept]
        order = np.lexsort((ids, -score))[:top]
        return ids[order], score[order]


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are pairs of a block of vectors and a block of queries, each query with the score it has to reach."""
        held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held[0] != row["block"]:
                    held = row["block"], _loaded(row)
                query_ids, queries = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], np.int64).reshape(row["query_n"], row["query_width"])
                vectors, queries = _aligned(held[1][1], queries)
                bucket = Bucket(held[1][0], vectors)
                least = np.frombuffer(row["least"], np.float64) if row["least"] is not None else np.full(len(query_ids), -np.inf)
                found = [bucket.best(int(i), q, t, top) for i, q, t in zip(query_ids, queries, least)]
                counts = [len(f[0]) for f in found]
                columns = [np.repeat(query_ids, counts), *map(np.concatenate, zip(*found))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _thresholds(key: tuple[pa.Scalar, ...], rows: pa.Table, reached: pa.Table) -> pa.Table:
    """The query block with the score that each of its queries has to reach."""
    packed = rows.to_pylist()[0] if rows.num_rows else None
    if packed is None:
        return pa.table({n: pa.array([], t) for n, t in _QUERY_TYPES.items()})
    least = {r["query_id"]: float(r["least"]) for r in reached.to_pylist()}
    ids = np.frombuffer(packed["query_ids"], np.int64)
    values = np.array([least.get(int(i), -np.inf) for i in ids])
    packed["least"] = values.tobytes()
    return pa.table({n: pa.array([packed[n]], t) for n, t in _QUERY_TYPES.items()})


_QUERY_TYPES = {
    "query_block": pa.int64(), "query_n": pa.int32(), "query_ids": pa.binary(), "queries": pa.binary(), "query_width": pa.int32(), "least": pa.binary(),
}
PAIRED = "query_block long, query_n int, query_ids binary, queries binary, query_width int, least binary"


def top_products(queries: DataFrame, vectors: DataFrame, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the `top` largest inner products with rows of `vectors`.

    Both are (vec_id, embedding); other columns are ignored. A row never finds itself (its own vec_id). Ties
    go to smaller vec_ids; fewer rows than `top` give fewer ranks. Rows of a repeated query id are asked once,
    with the first of their vectors. Vectors are searched a block of one length bucket at a time. Each query
    first searches the blocks of the longest vectors; the score of its last rank there is what the other blocks
    have to reach, and lets them drop vectors by length or by single coordinates. Blocks of queries meet blocks
    of vectors: every task holds one of each, and sends on at most `top` rows per query.
    """
    spark = vectors.sparkSession
    packed = scratch_table(blocks(quantized(vectors, scale), BLOCK), "blocks")
    asked = quantized(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("length2", F.lit(1).cast("long"))
    asked = scratch_table(blocks(asked, QUERIES).select(
        F.col("block").alias("query_block"), F.col("n").alias("query_n"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"),
        F.col("width").alias("query_width"), F.lit(None).cast("binary").alias("least"),
    ), "queries")
    sizes = packed.select("block", "n").orderBy("block").limit(STARTING).collect()
    if not sizes or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    last, start_at, seen = packed.agg(F.max("block")).first()[0], 0, 0
    for row in sizes:  # the longest vectors, until they fill a block
        start_at, seen = row["block"], seen + row["n"]
        if 2 * seen >= BLOCK:
            break

    def met(asked: DataFrame, first: int, last: int) -> DataFrame:
        """Every query block goes to every block of vectors from `first` to `last`."""
        sent = asked.withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        pairs = packed.where(F.col("block").between(first, last)).join(sent, "block")
        return pairs.mapInArrow(_search(top), "query_id long, vec_id long, score long")

    found = scratch_table(met(asked, 0, start_at), "longest")
    if start_at < last:
        reached = _ranked(found, top).where(F.col("rank") == top).select("query_id", F.col("score").alias("least"))
        parts = math.ceil(asked.agg(F.sum("query_n")).first()[0] / QUERIES)
        placed = reached.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        bounded = asked.groupBy("query_block").cogroup(placed.groupBy("query_block")).applyInArrow(_thresholds, PAIRED)
        found = found.unionByName(met(bounded, start_at + 1, last))
    return _ranked(found, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
