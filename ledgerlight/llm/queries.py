"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import curriculum, decontaminate, kneser_ney, language, lexical, minhash, periodic, records, retrieval, secrets, simhash, toxicity, warc
from ledgerlight.llm.oracles import ORACLES  # noqa: F401
from ledgerlight.llm.shared import remainder, scratch_table, table, word_count
from ledgerlight.session import scratch_path


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.score(docs.withColumn("held_out", held_out), model).withColumn("train_tokens", F.lit(model.tokens).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    scorer = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    found = toxicity.score(docs.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1), scorer)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = scratch_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    planned = curriculum.plan(sized, F.col("size"), curriculum.hash_key(F.col("doc_id")))
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda total, c: total + c["taken"])
    return planned.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"),
        F.round(F.get("_copies", F.lit(0))["position"], 6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    warc.write(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    found = warc.read(spark, archives)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to_id")).alias("refers_to"),
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.fold(docs)))
    found = language.predict(docs.select("doc_id", "text", language.fold(docs).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return retrieval.top_products(vectors.where("vec_id % 100 = 0"), vectors)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(written(of(*secrets.KINDS[:3])).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def op10_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.tokenized(table(spark, folder, "documents").select("doc_id", "text"))


def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    def digits(column: str) -> Column:
        return F.lower(F.hex(column))

    return minhash.with_edits(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_chars", digits("edited_sha256").alias("edited_sha256"), digits("signature").alias("fingerprint"),
        digits("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    indexed = lexical.index(table(spark, folder, "documents"))
    return lexical.search(indexed, table(spark, folder, "benchmark"))


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.detect(table(spark, folder, "documents").select("doc_id", "text"), plant=True, whole=False)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {
    f.__name__: f for f in (
        op1_simhash, op2_decontamination, op3_kneser_ney, op4_toxicity, op5_curriculum, op6_warc, op7_language, op8_retrieval, op9_secrets, op10_records,
        op11_fingerprints, op12_lexical, op13_runs,
    )
}
