"""The registered queries of this subpackage, thin over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrante.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of a shard.
SHARD_BYTES = 1 << 20


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.licenses import scan_licenses, train

    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, train(docs))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.pages import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, with_ids=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.token_files import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.substrings import MIN_WORDS, substring_spans

    found = substring_spans(table(spark, sf_dir, "documents"), MIN_WORDS)
    spans = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])))
    return found.select("doc_id", "text", "n_removed", spans.alias("removed_spans"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.multi_index import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrante.llm.suffix_dedup import remove_repeated_strings

    return remove_repeated_strings(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_text": op5_html_text,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_multi_index": op9_multi_index,
    "op10_quality": op10_quality,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_suffix_dedup": op13_suffix_dedup,
    "pipeline": pipeline,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return oracles.statements()
