"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import bpe, conversation_repair, conversation_sql, fingerprints, latent, licences, prefix_bpe, prefix_trie, sequences, signature_join, sketch_dedup, store, suffix_dedup, toxicity, warc
from hazardframe.operators.common import materialise

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: End mark that the token files append to every document.
END_ID = 2


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = fn
        if oracle:
            LLM_ORACLES[name] = oracle
        return fn

    return wrap


@_query(
    "op2_warc_zip",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest)
    """,
)
def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(warc.classify(table(spark, sf_dir, "pages")), store.shared_uri(spark, "warc"))
    read = warc.read_records(warc.list_records(packages), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = materialise(suffix_dedup.remove(docs).select(*columns, "t"), "removed")
    return suffix_dedup.with_passages(done, docs).select(*columns, "n_passage_words")


@_query("op5_arrow_sequences")
def op5_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sequences.write_sequences(table(spark, sf_dir, "documents"), store.shared_uri(spark, "sequences"), tokenizer_file(), END_ID)
    return sequences.read_documents(index)


@_query("op7_forced_boundary_bpe")
def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


@_query("op9_count_min_dedup")
def op9_count_min_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op10_signature_join")
def op10_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked_components(table(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.is_held_out())
    rows = toxicity.scores(docs, model)
    return rows.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query("op1_latent_decontamination")
def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latent.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("t")


@_query("op3_bottom_k_fingerprints")
def op3_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


@_query("op6_licence_scan")
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


@_query("op11_prefix_bpe")
def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), ranks_file())


@_query("op12_conversation_repair", conversation_sql.REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@_query("op13_conversation_trie", conversation_sql.TRIE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))
