"""Trained forests as stored artefacts, and checks of what they do.

A model has a name and a version. Its folder holds the node table and a card: feature list, training
statistics, size. Scoring loads both by version and refits nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions import scores as N
from ledgerlight.operators.quantiles import exact_percentiles
from ledgerlight.plans.iforest import NODE_SCHEMA, Forest, fit, raw_from_score, training_stats, with_scores
from ledgerlight.session import scratch_path

STATS = "n_training_samples long, outlier_pct double, score_min double, score_max double, score_mean double, score_std double"
CARD = f"features array<string>, trained_at string, {STATS}"
#: Indices from which a probe counts as flagged, and below which as ordinary.
EXTREME, ORDINARY = 65, 40


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str, version: str) -> str:
        return f"{self.path}/{name}/{version}"

    def train(self, name: str, version: str, rows: DataFrame, features: list[str], key: str, trained_at: str | None = None) -> Forest:
        """Fit a forest on `rows` (unique id `key`) and store it; a version that is there already is an error.

        The card is written last: a version whose training broke off has none and can't be loaded.
        """
        folder = self._folder(name, version)
        if self._card(name, version) is not None:
            raise FileExistsError(f"model {name} {version}")
        fit(rows, features, key).write.mode("overwrite").parquet(f"{folder}/nodes")
        forest = Forest.from_nodes(self.nodes(name, version), features)
        stats = training_stats(with_scores(rows, {"_s": forest}).select(raw_from_score(F.col("_s")).alias("raw_score")))
        card = stats.select(F.array(*[F.lit(f) for f in features]).alias("features"), F.lit(trained_at).cast("string").alias("trained_at"), *stats.columns)
        card.coalesce(1).write.mode("overwrite").json(f"{folder}/card")
        return forest

    def _card(self, name: str, version: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(CARD).json(f"{self._folder(name, version)}/card")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def card(self, name: str, version: str) -> DataFrame:
        """One row: features, trained_at and the statistics of the training rows' raw scores."""
        found = self._card(name, version)
        if found is None:
            raise FileNotFoundError(f"model {name} {version}")
        return found

    def nodes(self, name: str, version: str) -> DataFrame:
        return self.spark.read.schema(NODE_SCHEMA).parquet(f"{self._folder(name, version)}/nodes")

    def load(self, name: str, version: str, features: list[str] | None = None) -> Forest:
        """The stored forest. `features`, if given, have to be those it was trained on, in their order."""
        stored = self.card(name, version).first()["features"]
        if features is not None and list(features) != list(stored):
            raise ValueError(f"model {name} {version} was trained on {list(stored)}, not {list(features)}")
        return Forest.from_nodes(self.nodes(name, version), list(stored))


# --- what a feature does ------------------------------------------------------------------------


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with its rows' places from 0 on in the given order, as column `name`; ties get any order.

    Rows are range-partitioned, sorted within the partitions and written; a row's place is its place in
    the partition and the rows of the partitions before. The driver sees one number per partition.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch_path(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, total = [], 0
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def with_donors(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """`df` with `donor_<column>`: the columns of another row, a random permutation of the rows by hashes of `key`.

    Two orders of the rows are numbered, and the row at a place of the one gives to the row at that place of the
    other: two range shuffles and a join by place, no window over the table. A row may give to itself.
    """
    def order(salt: str) -> list:
        return [F.md5(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary")), F.col(key)]

    taking = numbered(df, order("to"), "_place")
    giving = numbered(df.select(key, *columns), order("from"), "_place").select("_place", *[F.col(c).alias(f"donor_{c}") for c in columns])
    return taking.join(giving, "_place").drop("_place")


def feature_inertness(df: DataFrame, forest: Forest, key: str, most: float = 0.0) -> DataFrame:
    """(feature, mean_shift, max_shift, inert): how far the index of rows moves when one feature's values are permuted.

    `inert`: no row's index moves by more than `most`. A feature that was constant in training is inert whatever
    values it has later. All variants of a batch of rows are scored in one pass.
    """
    names = forest.features
    donors = with_donors(df.select(key, *names), names, key)
    variants = {"_base": forest}
    for i, f in enumerate(names):
        other = Forest([f"donor_{f}" if g == f else g for g in names], forest.feature, forest.cut, forest.path, forest.subsample)
        variants[f"_{i}"] = other
    scored = with_scores(donors, variants)

    def index(column: str):
        return N.index_from_raw(raw_from_score(F.col(column)))

    shifts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(index(f"_{i}") - index("_base")).alias("shift")) for i, f in enumerate(names)]))
    return scored.select(shifts.alias("s")).groupBy("s.feature").agg(
        F.round(F.avg("s.shift"), 4).alias("mean_shift"), F.max("s.shift").cast("double").alias("max_shift")
    ).withColumn("inert", F.col("max_shift") <= most)


def probe_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Two rows made of the training data: `extreme`, each feature a range above its maximum, and `ordinary`, all medians."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = df.select(pairs.alias("p")).select("p.*")
    middle = exact_percentiles(long, "feature", "x", [0.5]).select("feature", "x", F.lit("ordinary").alias("probe"))
    far = long.groupBy("feature").agg((2 * F.max("x") - F.min("x")).alias("x")).withColumn("probe", F.lit("extreme"))
    return middle.unionByName(far).groupBy("probe").pivot("feature", sorted(features)).agg(F.first("x"))


def probes(df: DataFrame, forest: Forest) -> DataFrame:
    """(probe, index, ok): the extreme probe is flagged, the ordinary one is not."""
    scored = with_scores(probe_rows(df, forest.features), {"_s": forest}).select("probe", N.index_from_raw(raw_from_score(F.col("_s"))).alias("index"))
    return scored.withColumn("ok", F.when(F.col("probe") == "extreme", F.col("index") >= EXTREME).otherwise(F.col("index") < ORDINARY))
