"""Registered queries of the operators, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import alignment, chat, exact_dedup, near_dedup, oracles, order_minhash, packing, quality_model, quality_rules, sharding, tokens, url_filters, vector_codes, warc
from codeloom.llm.common import documents, prepare
from codeloom.llm.text_stats import SENTENCE_ENDS


VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.score(docs, quality_model.train(docs, labels))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    decoded = tokens.decode_documents(tokens.encode_documents(documents(spark, sf_dir), path), path)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


SHARD_WEIGHTS = [1.0] * 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARD_WEIGHTS, grown=[*SHARD_WEIGHTS, 1.0])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


URL_RULES = [url_filters.Rule("block", "net"), url_filters.Rule("allow", "example.net", "/en/"),
             url_filters.Rule("block", "example.com", "/de/"), url_filters.Rule("allow", "org", "/fr/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("purity")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path()).drop("ids")


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(PROBE).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(PROBE).alias("text")))).alias("x"))
    return chat.summary(chat.format_conversations(given.unionByName(probe.select("conv_id", "x.*"))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepare(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_model, op2_near_dedup, op3_exact_dedup, op4_bpe, op5_sharding, op6_quality_rules, op7_url_filters,
                                     op8_packing, op9_chat_format, op10_warc, op11_alignment,
                                     op12_order_minhash, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """Classifier scores, tokenizer ids, the packing and alignment of tokens and 64-bit hash fingerprints have no SQL form."""
    rules = oracles.quality_rules(quality_rules.RULES, quality_rules.BOILERPLATE, r"[#*$%&|<>!~^=_{}\[\]\\@]", r"[|<>]", SENTENCE_ENDS,
                                  quality_rules.ends_of_all_scripts())
    return {"op2_near_dedup": oracles.NEAR_DEDUP, "op3_exact_dedup": oracles.EXACT_DEDUP, "op5_sharding": oracles.SHARDING,
            "op6_quality_rules": rules, "op7_url_filters": oracles.url_filters(URL_RULES), "op9_chat_format": oracles.chat_format(PROBE),
            "op10_warc": oracles.WARC, "op13_vector_codes": oracles.vector_codes(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE)}
