"""Registered queries of the training-data operators, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.llm import bytebpe, jaccard, language, preference, quality, tiling, tokencount, toxicity, vectors, wrapper
from burrow.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return preference.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)))


def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.classify(spark, docs, table(spark, sf_dir, "labels")).drop("text")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark, table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)")
    known = language.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return language.identify(docs.select("doc_id", "text"), known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents", "doc_id", "text"), F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    model = toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels").where(~held_out), 1500))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"), F.transform("toxic_spans", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("spans"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_preference, op2_tiling, op3_quality, op4_jaccard, op5_wrapper, op6_language, op7_bytebpe, op8_toxicity, op9_vectors, op10_tokencount, pipeline)}
ORACLE_SQL = {"op1_preference": preference.ORACLE}
