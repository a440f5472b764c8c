"""The operators of this package as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtide.llm import alignment, bloom_model, chunk_dedup, lexical_search, suffixes, training_suffixes
from jobtide.llm.byte_bpe import decode, encode
from jobtide.llm.common import documents
from jobtide.llm.fingerprints import spliced_fingerprints
from jobtide.llm.near_duplicates import near_duplicates
from jobtide.llm.packing import pack
from jobtide.llm.quality_rules import fit as fit_references, quality_rules
from jobtide.llm.resampling import resample
from jobtide.llm.sql import CONTAMINATION, LEXICAL_SEARCH, NEAR_DUPLICATES, QUALITY_RULES
from jobtide.llm.token_counts import token_counts

_PATTERN = public_tokenizers.PATTERN


def op1_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), _PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_resample_quality(spark: SparkSession, folder: str) -> DataFrame:
    return resample(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op3_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _digests(suffixes.dedup(documents(spark, folder)))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), _PATTERN)


def op5_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = quality_rules(docs.select("doc_id", "text"), references=fit_references(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
    # sums of doubles differ in the last places with their order
    return found.select(*names.split(), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op6_minmax_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(documents(spark, folder), vocab, _PATTERN)
    hashed = encoded.select(F.struct("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")).alias("doc_id"), "ids")
    texts = decode(hashed, vocab)
    return texts.select("doc_id.doc_id", "doc_id.n_tokens", "doc_id.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return spliced_fingerprints(documents(spark, folder))


def op9_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _digests(chunk_dedup.dedup(documents(spark, folder)))


def _digests(kept: DataFrame) -> DataFrame:
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_bloom_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = documents(spark, folder), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = bloom_model.score(docs, bloom_model.fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return training_suffixes.report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return alignment.report(documents(spark, folder), public_tokenizers.path(names[0]), _PATTERN, public_tokenizers.path(names[1]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_sequences,
        op2_resample_quality,
        op3_repeated_spans,
        op4_token_counts,
        op5_quality_divergence,
        op6_minmax_near_duplicates,
        op7_bpe_round_trip,
        op8_fingerprints,
        op9_chunk_dedup,
        op10_bloom_language_model,
        op11_lexical_search,
        op12_decontamination,
        op13_tokenizer_alignment,
    )
}
ORACLES: dict[str, str] = {
    op5_quality_divergence.__name__: QUALITY_RULES,
    op6_minmax_near_duplicates.__name__: NEAR_DUPLICATES,
    op11_lexical_search.__name__: LEXICAL_SEARCH,
    op12_decontamination.__name__: CONTAMINATION,
}
