"""The queries of this subpackage, by the names they are registered under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_cnn, conversations, fill_middle, licenses, oracles, pii, sharding
from .common import documents
from .imatch import fingerprints
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .packing import pack
from .perplexity import quality_rules
from .repeats import remove_repeats
from .token_files import token_files


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(documents(spark, sf_dir), text=False)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_imatch": op6_imatch,
    "op7_personal_data": op7_personal_data,
    "op8_licenses": op8_licenses,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeats": op10_repeats,
    "op4_token_files": op4_token_files,
    "op11_conversations": op11_conversations,
    "op12_fill_middle": op12_fill_middle,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL: dict[str, str] = {
    "op8_licenses": licenses.oracle_sql(),
    "op11_conversations": oracles.repairs(),
    "op12_fill_middle": oracles.fill_in_middle(),
    "op13_sharding": oracles.shards(),
}
