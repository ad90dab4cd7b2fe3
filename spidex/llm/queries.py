"""The queries of this subpackage: op1_ to op10_, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spidex.llm import langid, linededup, media, mixing, packing, quality, rules, simhash, suffix, tokenbin
from spidex.llm.common import cut, documents, labels, scratch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), capacity=2048, end_id=0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(documents(spark, sf_dir)).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(documents(spark, sf_dir))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as path:
        tokenbin.write(documents(spark, sf_dir), path("tokens"), tokenizer_path(), end_id=2)
        return cut(tokenbin.decoded(tokenbin.read(spark, path("tokens"))))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.to_media(documents(spark, sf_dir)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_mix_sources,
        op3_suffix_dedup,
        op4_line_dedup,
        op5_token_binary,
        op6_quality_rules,
        op7_media_columns,
        op8_simhash_near_dedup,
        op9_language_id,
        op10_quality_classifier,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": suffix.ORACLE_SQL, "op4_line_dedup": linededup.ORACLE_SQL}
