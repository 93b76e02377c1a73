"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from leadloom.llm import chat, exact_dedup, language_id, line_dedup, mixing, neighbours, ngram_join, packing, toxicity, warc
from leadloom.llm.common import documents

QUERIES = {
    "op1_ngram_jaccard_join": lambda spark, sf_dir: ngram_join.query(spark, documents(spark, sf_dir)),
    "op2_language_id": lambda spark, sf_dir: language_id.query(spark, documents(spark, sf_dir)),
    "op3_exact_dedup": lambda spark, sf_dir: exact_dedup.query(spark, documents(spark, sf_dir)),
    "op4_nearest_neighbours": lambda spark, sf_dir: neighbours.query(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op5_line_dedup": lambda spark, sf_dir: line_dedup.query(spark, documents(spark, sf_dir)),
    "op6_toxicity": lambda spark, sf_dir: toxicity.query(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op7_chat_formatting": lambda spark, sf_dir: chat.query(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op8_source_mixing": lambda spark, sf_dir: mixing.query(spark, documents(spark, sf_dir)),
    "op9_packing": lambda spark, sf_dir: packing.query(spark, documents(spark, sf_dir)),
    "op10_warc_revisits": lambda spark, sf_dir: warc.query(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")),
}

SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_chat_formatting": chat.SQL,
    "op8_source_mixing": mixing.SQL,
    "op10_warc_revisits": warc.SQL,
}
