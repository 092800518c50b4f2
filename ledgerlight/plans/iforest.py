"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Training draws every tree's rows by hashing the row key, so the model does not depend on how the
data is partitioned; trees are then grown in parallel, one small group per tree. The model is a
table of tree nodes. Scoring ships the nodes (at most trees x 511 rows) to the executors and walks
all trees for a batch of rows at once.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Model size and seed.
TREES = 200
SUBSAMPLE = 256
SEED = 42
EULER = 0.5772156649
#: Levels of a tree on which a block of rows is compared with every node's cut.
TOP_LEVELS = 4
#: Rows that are walked together.
BLOCK = 1 << 15

# Executors get this module's functions with the job, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, cut double, left int, right int, depth int, size long"
)


def average_path(size: float) -> float:
    """Mean path length of an unsuccessful search among `size` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + EULER) - 2.0 * (size - 1.0) / size


HASH_SPACE = float(1 << 52)
#: Darts a row throws at all forests from which on it isn't asked first whether any of them hits.
MANY_DARTS = 32


def _digest(*parts: Column) -> Column:
    """MD5 of the parts, which any engine can compute."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def _digits(digest: Column, first: int) -> Column:
    """Uniform number in [0, 1): 52 bits of a digest from hex digit `first` on."""
    return F.conv(F.substring(digest, first, 13), 16, 10).cast("double") / F.lit(HASH_SPACE)


def _unit(*parts: Column) -> Column:
    return _digits(_digest(*parts), 1)


def unit(*parts: object) -> float:
    """`_unit` of plain values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / HASH_SPACE


def _darts(trees: int, chance: float) -> int:
    return math.ceil(trees * chance)


def _candidate(key: Column, seeds: list[int], trees: int, chance: float) -> Column:
    """Whether any dart of the row hits, told by the first digits of their digests alone: an MD5 is hexadecimal."""
    darts = _darts(trees, chance)
    most = min(2**52, math.ceil(trees * chance / darts * HASH_SPACE))
    if most == 2**52:
        return F.lit(True)

    def hits(k: Column) -> Column:
        found = F.lit(False)
        for seed in seeds:
            for j in range(darts):
                found = found | (_digest(k, F.lit(j), F.lit(seed)) < f"{most:013x}")
        return found

    return F.exists(F.array(key), hits)  # the key is made once for all darts


def _chosen_trees(key: Column, seed: int, trees: int, chance: float) -> Column:
    """Trees a row is a candidate for, about `trees * chance` of them.

    The row throws a few hashed darts at the trees instead of being tested against every tree.
    """
    if chance >= 1.0:
        return F.sequence(F.lit(seed * trees), F.lit(seed * trees + trees - 1))
    darts = _darts(trees, chance)

    digests = F.transform(F.sequence(F.lit(0), F.lit(darts - 1)), lambda j: _digest(key, j, F.lit(seed)))
    thrown = F.filter(digests, lambda d: _digits(d, 1) < trees * chance / darts)
    return F.array_distinct(F.transform(thrown, lambda d: (F.floor(_digits(d, 14) * trees) + seed * trees).cast("int")))


def draw_samples(
    df: DataFrame, features: list[str], key: str, n_rows: int, trees: int = TREES, subsample: int = SUBSAMPLE,
    seeds: list[int] | None = None,
) -> DataFrame:
    """(tree_id, draw, features): `subsample` rows without repetition for every tree.

    Every row is a candidate for a tree with twice the chance that it is drawn, by a hash of its key, and each
    tree takes its candidates with the smallest hash of (key, tree). The rule is the same at every size:
    a tree's rows are a uniform sample of the whole table, seeds draw independently, and each tree
    sorts about twice its subsample.
    """
    seeds = [SEED] if seeds is None else seeds
    pool = df.select(F.col(key).cast("string").alias("_key"), *[F.col(f).cast("double").alias(f) for f in features])
    chance = min(1.0, 2.0 * subsample / max(1, n_rows))
    if chance * trees * len(seeds) < MANY_DARTS:
        # Most rows of a large table are drawn for no tree; only the others' darts are looked at one by one.
        pool = pool.where(_candidate(F.col("_key"), seeds, trees, chance))
    chosen = F.flatten(F.array(*[_chosen_trees(F.col("_key"), s, trees, chance) for s in seeds]))
    pairs = pool.select("_key", *features, F.explode(chosen).alias("tree_id")).withColumn(
        "draw", _unit(F.col("_key"), F.col("tree_id"), F.lit("draw"))
    )
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy("draw", "_key"))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= subsample).drop("_rank", "_key")


def grow_tree(values: np.ndarray, limit: int, tree_id: int) -> list[tuple]:
    """Nodes (id, feature, cut, depth, size) of one tree; children of node i are 2i+1 and 2i+2.

    Feature and cut are functions of hashes of the tree and the node: the same rows give the same tree
    wherever it is grown. A cut that would leave the left side empty becomes the largest value.
    """
    nodes, stack = [], [(0, values, 0)]
    while stack:
        node, rows, depth = stack.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, np.nan, depth, len(rows)))
            continue
        feature = int(usable[int(unit(tree_id, node, "feature") * len(usable))])
        cut = float(low[feature] + unit(tree_id, node, "cut") * (high[feature] - low[feature]))
        if not low[feature] < cut <= high[feature]:
            cut = float(high[feature])
        below = rows[:, feature] < cut
        nodes.append((node, feature, cut, depth, len(rows)))
        stack.append((2 * node + 2, rows[~below], depth + 1))
        stack.append((2 * node + 1, rows[below], depth + 1))
    return nodes


def fit(
    df: DataFrame, features: list[str], key: str, n_rows: int | None = None, trees: int = TREES,
    subsample: int = SUBSAMPLE, seeds: list[int] | None = None,
) -> DataFrame:
    """Node table of a forest over `df`, whose rows have the unique id `key`.

    Several seeds give several forests in one job, tree ids being seed * trees + i.
    """
    n_rows = df.count() if n_rows is None else n_rows
    psi = max(1, min(subsample, n_rows))
    limit = max(1, math.ceil(math.log2(max(psi, 2))))
    columns = list(features)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(frame["tree_id"].iloc[0])
        nodes = grow_tree(frame[columns].to_numpy(float), limit, tree_id)
        return pd.DataFrame(
            [(tree_id, n, f, c, *((2 * n + 1, 2 * n + 2) if f >= 0 else (-1, -1)), d, s) for n, f, c, d, s in nodes],
            columns=["tree_id", "node_id", "feature", "cut", "left", "right", "depth", "size"],
        )

    drawn = draw_samples(df, columns, key, n_rows, trees, psi, seeds)
    return drawn.groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by its key if it is read in fewer parts than there are cores, as a table of few row groups is.

    Rows cost far more in the forests than in the shuffle. Larger tables come in more parts and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@dataclass
class Forest:
    """Nodes in array form: complete binary trees whose last level holds path lengths."""

    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    subsample: int

    @classmethod
    def from_nodes(cls, nodes: DataFrame, features: list[str], seed: int | None = None, trees: int = TREES) -> Forest:
        """Collect a node table (bounded by trees x nodes per tree), optionally one seed's forest."""
        if seed is not None:
            nodes = nodes.where(F.col("tree_id").between(seed * trees, seed * trees + trees - 1))
        table = nodes.toPandas()
        ids = {t: i for i, t in enumerate(sorted(table["tree_id"].unique()))}
        levels = max(1, int(table["depth"].max()))
        inner = 2**levels - 1
        feature = np.zeros((len(ids), max(inner, 1)), dtype=np.int16)
        cut = np.full((len(ids), max(inner, 1)), np.inf)
        path = np.zeros((len(ids), 2**levels))
        psi = int(table.loc[table["node_id"] == 0, "size"].max())
        for row in table.itertuples(index=False):
            tree = ids[row.tree_id]
            if row.feature >= 0:
                feature[tree, row.node_id], cut[tree, row.node_id] = row.feature, row.cut
            else:
                # A leaf above the last level is passed on the left (its cut is infinite).
                slot = row.node_id
                for _ in range(levels - row.depth):
                    slot = 2 * slot + 1
                path[tree, slot - inner] = row.depth + average_path(row.size)
        return cls(list(features), feature, cut, path, psi)

    def scores(self, values: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Isolation score s in (0, 1]; above 0.5 means unusual. Rows are walked in cache-sized blocks.

        On the first levels whole columns are compared with every cut and each row keeps the outcome of its own node:
        that is several times faster than looking up every row's node, as on the levels below.
        A block's arrays are made once and filled again on every level; places have numpy's own index type.
        """
        total = np.empty(len(values))
        levels = int(math.log2(self.path.shape[1]))
        top = min(TOP_LEVELS, levels)
        of_features, of_cuts = self.feature[:, :2**top - 1].tolist(), self.cut[:, :2**top - 1].tolist()
        # Nodes and leaves are numbered from 1 on: those below node i are 2 * i and 2 * i + 1.
        cuts = np.pad(self.cut, ((0, 0), (1, 0)))
        paths = np.pad(self.path, ((0, 0), (self.path.shape[1], 0)))
        for start in range(0, len(values), block):
            columns = np.ascontiguousarray(values[start:start + block].T)
            size = columns.shape[1]
            flat, rows = columns.ravel(), np.arange(size, dtype=np.intp)
            offsets = np.pad(self.feature, ((0, 0), (1, 0))).astype(np.intp) * size
            slot, place = np.empty(size, np.intp), np.empty(size, np.intp)
            value, bound, right, lengths = np.empty(size), np.empty(size), np.empty(size, bool), np.zeros(size)
            passed, number = np.empty((2**top - 1, size), bool), np.empty(size, np.uint8)
            turns, of_feature, of_node = passed.view(np.uint8), list(columns), list(passed)
            # A level's outcomes are halved by each turn on the way there, first to last, until its first row holds everybody's own.
            halvings = [[(turns[2**level - 1:][:half], turns[2**level - 1 + half:][:half], turns[2**above - 1])
                         for above in range(level) for half in [2 ** (level - above - 1)]] for level in range(1, top)]
            for tree in range(len(self.path)):
                offset, cut = offsets[tree], cuts[tree]
                for outcome, feature, bar in zip(of_node, of_features[tree], of_cuts[tree]):
                    np.greater_equal(of_feature[feature], bar, out=outcome)
                np.copyto(number, turns[0])  # a row's place in its level
                for level, steps in enumerate(halvings, 1):
                    for ones, others, turn in steps:
                        np.bitwise_xor(others, ones, out=others)
                        np.bitwise_and(others, turn, out=others)
                        np.bitwise_xor(ones, others, out=ones)
                    np.add(number, number, out=number)
                    np.add(number, turns[2**level - 1], out=number)
                np.add(number, 2**top, out=slot)
                for _ in range(levels - top):
                    offset.take(slot, out=place, mode="clip")
                    place += rows
                    flat.take(place, out=value, mode="clip")
                    cut.take(slot, out=bound, mode="clip")
                    np.greater_equal(value, bound, out=right)
                    slot += slot
                    slot += right
                paths[tree].take(slot, out=value, mode="clip")
                lengths += value
            total[start:start + block] = lengths
        return np.power(2.0, -total / len(self.path) / max(average_path(self.subsample), 1e-12))

    def score_column(self) -> Column:
        """Score of the feature columns as a Spark column (Arrow batches)."""
        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])
            return pd.Series(self.scores(values))

        return score(*[F.col(f).cast("double") for f in self.features])


def _blocks(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[list[np.ndarray]]:
    """Columns of Arrow batches as numbers, several batches together: BLOCK rows or more, the last ones fewer."""
    held, n = [], 0
    for columns in batches:
        held.append([c.to_numpy(float, na_value=np.nan) for c in columns])
        n += len(columns[0])
        if n >= BLOCK:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def with_scores(df: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """`df` with a score column per forest; all walk the same blocks of rows, whatever features each of them takes."""
    features = list(dict.fromkeys(f for forest in forests.values() for f in forest.features))

    @F.pandas_udf(", ".join(f"{name} double" for name in forests))
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in _blocks(batches):
            values = dict(zip(features, columns))
            yield pd.DataFrame({name: forest.scores(np.column_stack([values[f] for f in forest.features])) for name, forest in forests.items()})

    # An iterator of one column alone would get no tuples.
    padded = features + features[:1] if len(features) == 1 else features
    return df.withColumn("_scores", scores(*[F.col(f).cast("double") for f in padded])).select(*df.columns, "_scores.*")


def scaling(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per feature, kept with the model (scores do not depend on it)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    return df.select(pairs.alias("p")).groupBy("p.feature").agg(
        F.avg("p.x").alias("mean"), F.stddev_pop("p.x").alias("std")
    )


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Features minus mean over population deviation (a zero deviation counts as 1)."""
    stats = df.agg(F.struct(
        *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"std_{f}") for f in features]
    )).scalar()

    def scaled(f: str) -> Column:
        spread = stats[f"std_{f}"]
        return ((F.col(f) - stats[f"mean_{f}"]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)).alias(f)

    return df.select(*[scaled(c) if c in features else F.col(c) for c in df.columns])


def raw_from_score(score: Column) -> Column:
    return F.lit(0.5) - score


def label_from_raw(raw: Column) -> Column:
    return F.when(raw < 0, -1).otherwise(1)


def training_stats(raw_scores: DataFrame, raw: str = "raw_score") -> DataFrame:
    """n, outlier share and range, mean, population deviation of the raw scores of the training rows."""
    x = F.col(raw)
    return raw_scores.agg(
        F.count("*").alias("n_training_samples"),
        F.round(F.count_if(x < 0) * 100.0 / F.count("*"), 2).alias("outlier_pct"),
        F.round(F.min(x), 4).alias("score_min"), F.round(F.max(x), 4).alias("score_max"),
        F.round(F.avg(x), 4).alias("score_mean"), F.round(F.stddev_pop(x), 4).alias("score_std"),
    )


def seed_stability(df: DataFrame, features: list[str], key: str, n_seeds: int = 10, trees: int = TREES) -> DataFrame:
    """Mean share of seeds that agree on a row's label, over forests of several seeds."""
    nodes = fit(df, features, key, trees=trees, seeds=list(range(n_seeds))).persist()
    try:
        forests = [Forest.from_nodes(nodes, features, s, trees) for s in range(n_seeds)]
    finally:
        nodes.unpersist()
    labels = with_scores(df, {f"_{i}": f for i, f in enumerate(forests)}).select(*[(F.col(f"_{i}") > 0.5).cast("int").alias(f"_{i}") for i in range(n_seeds)])
    outliers = sum((F.col(f"_{i}") for i in range(n_seeds)), F.lit(0))
    agreement = F.greatest(outliers, F.lit(n_seeds) - outliers) / n_seeds
    return labels.agg(F.round(F.avg(agreement), 4).alias("agreement"))
