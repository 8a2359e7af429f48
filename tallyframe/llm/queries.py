"""Registered queries of the operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_source_mixing": oracles.OP1, "op3_benchmark_decontamination": oracles.OP3, "op4_ngram_jaccard_join": oracles.OP4,
    "op5_line_dedup": oracles.OP5, "op13_conversation_prefix_trie": oracles.OP13,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.decontaminate import contamination

    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked, out = contamination(docs, table(spark, folder, "benchmark"))
    fields = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return marked.select("doc_id", *[F.col(out).getField(f).alias(f) for f in fields])


@query
def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.mixture import mixture

    return mixture(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.sharding import shard

    placed = shard(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.extract import extract

    pages, out = extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col(out).alias("text"), F.char_length(out).cast("long").alias("n_chars"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.lines import dedup_lines

    rows, out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(out).getField(f).alias(f) for f in ("n_lines", "n_dropped", "kept_sha256")])


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.common import crc_mod
    from tallyframe.llm.quality import FOLD, FOLDS, THRESHOLD, score

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    rows, out = score(docs, table(spark, folder, "labels"))
    fields = [F.col(out).getField(f).alias(f"{f}_score" if f != "score" else f) for f in ("own", "host", "path", "score")]
    kept = (F.col(out).getField("score") >= THRESHOLD).alias("kept")
    return rows.select("doc_id", (crc_mod("doc_id", FOLDS) == FOLD).alias("held_out"), *fields, kept)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.common import crc_mod
    from tallyframe.llm.toxicity import FOLD, FOLDS, score

    rows, out = score(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    value = F.col(out).getField("score")
    spans = F.col(out).getField("spans")
    return rows.select(
        "doc_id", (crc_mod("doc_id", FOLDS) == FOLD).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"),
        F.size(spans).cast("long").alias("n_spans"),
    )


@query
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.fingerprint import compare

    return compare(table(spark, folder, "documents"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.similarity import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_katz_backoff_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.language_model import score

    return score(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op13_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.common import staged
    from tallyframe.llm.trie import end_digests, prefix_trie, shared_openings, turn_tokens

    trie = prefix_trie(*shared_openings(staged(turn_tokens(table(spark, folder, "conversations")))))
    rows = trie.nodes.join(end_digests(trie.ends), ["p1", "p2"], "left")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


@query
def op12_bpe_encoding_decoding(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tallyframe.llm.bpe import Vocabulary, decode, encode

    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = encode(table(spark, folder, "documents"), vocabulary).select(F.struct("doc_id", "ids").alias("row"), "ids")
    rows = decode(encoded, vocabulary, id_column="row")
    ids = F.col("row.ids")
    return rows.select(
        "row.doc_id", F.floor(F.octet_length(ids) / 4).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tallyframe.llm.whitening import whitened_components

    rows = whitened_components(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
