"""Registered queries of the subpackage with their DuckDB SQL, and their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    capfilters,
    divergence,
    exactdedup,
    filteraudit,
    langid,
    ngramjoin,
    oracles,
    packing,
    pieces,
    quality,
    quotes,
    sharding,
    tokencounts,
    urlfilter,
)
from weftline.llm.encoders import Tokenizer
from weftline.runtime import configure, scratch_path

TOKEN_LIMIT = 2_048
SEQUENCE_TOKENS = 4_096
END_TOKEN = 1
SHARDS = 40
# Rules of the URL filter (fixed values).
URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> Tokenizer:
    return Tokenizer(public_tokenizers.path("word_bpe_49k.json"), space_free=True)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = tokencounts.count_tokens(docs, word_tokenizer(), scratch_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return shards.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), word_tokenizer(), SEQUENCE_TOKENS, END_TOKEN)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"),
        F.col("keep._id").alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.split_part("digest", F.lit(":"), F.lit(1)).alias("text_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_measures(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode_pieces(pieces.encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by a model of the documents' languages, the pages' declarations and their hosts."""
    model = langid.train(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages")
    host, _ = urlfilter.split_url(F.col("url"))
    rows = pages.select("page_id", langid.page_text(F.col("html")).alias("text"), langid.declared_language(F.col("html")).alias("said"), host.alias("host"))
    return langid.identify(rows, model, "page_id", "text", F.col("said"), F.col("host")).drop("content")


def quoting_view(conversations: DataFrame) -> DataFrame:
    """The conversations as mails: an assistant quotes the message before, and the one before that a level deeper;
    a user quotes the message two turns before."""
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_one"))
    earlier = conversations.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("_two"))

    def quoted(text: str, marks: str):
        return F.concat(F.lit(marks), F.replace(F.col(text), F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))

    deep = F.when(F.col("role") == "assistant", quoted("_two", "> > ")).when(F.col("role") == "user", quoted("_two", "> "))
    near = F.when(F.col("role") == "assistant", quoted("_one", "> "))
    both = conversations.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", "role", F.concat(F.coalesce(deep, F.lit("")), F.coalesce(near, F.lit("")), "text").alias("text"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(quoting_view(table(spark, sf_dir, "conversations")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.source_divergence(table(spark, sf_dir, "documents"))
    return found.select("lang", "source", "part", "item", "value", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sharding,
        op3_best_fit_packing,
        op4_language_id,
        op5_exact_dedup,
        op6_quality_rules,
        op7_sentencepiece,
        op8_chat_formatting,
        op9_url_filter,
        op10_ngram_jaccard_join,
        op11_filter_interaction_audit,
        op12_embedding_near_dedup,
        op13_source_divergence_audit,
    )
}
ORACLES = {
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op6_quality_rules": oracles.quality_rules(quality.Rules()),
    "op8_chat_formatting": oracles.CHAT_FORMATTING,
    "op10_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op11_filter_interaction_audit": oracles.FILTER_AUDIT,
    "op12_embedding_near_dedup": oracles.NEAR_VECTORS,
    "op13_source_divergence_audit": oracles.SOURCE_DIVERGENCE,
}
