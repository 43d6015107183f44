"""Queries of the training-data operators on the driver's tables.

Each query applies one operator with its production parameters to the whole table. Operators are
imported when their query runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit
from .common import new_path, read_documents

ORACLES: dict[str, str] = {"op13_filter_audit": filter_audit.SQL}


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_orc

    path = new_path(spark, "token-orc")
    token_orc.write(read_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.digest(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.spans(read_documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(read_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    path = new_path(spark, "sequences")
    packing.write_sequences(read_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return packing.digest(spark, path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts

    return token_counts.count_tokens(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    return language.identify(read_documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    path = new_path(spark, "media")
    media.write(read_documents(spark, sf_dir), path)
    return media.features(media.read(spark, path))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    classes = simhash.near_duplicate_classes(read_documents(spark, sf_dir))
    return classes.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.find(read_documents(spark, sf_dir)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.variants(spelling.word_counts(read_documents(spark, sf_dir)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_orc, op2_toxicity, op3_substrings, op4_licenses, op5_packing,
        op6_decontaminate, op7_token_counts, op8_language, op9_media, op10_simhash,
        op11_pii, op12_spelling, op13_filter_audit,
    )
}
