"""The registered queries of this subpackage, op1 to op13, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm import collocations, lexical_search, line_dedup, mixing
from scoreframe.llm.common import read, spread


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return quality.score(spread(docs), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import license_scan

    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return license_scan.by_document(license_scan.scan(docs, license_scan.train(docs)), docs)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"), ordered=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import chat

    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(rows)).drop("n_tokens")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import html_extract

    return html_extract.extract_text(spread(read(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import decontam

    return decontam.overlaps(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import suffix_dedup

    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), least=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import hyperminhash

    return hyperminhash.near_duplicates(read(spark, sf_dir, "documents"), n_words=2, percent=80)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import url_filter

    return url_filter.judge(spread(read(spark, sf_dir, "pages").select("page_id", "url")))


def op10_avi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scoreframe.llm import media

    return media.features(media.to_avi(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_frequent_lines(docs, least=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"), least=30, longest=4, first=2000, share=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_pfair_mix": op2_pfair_mix,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_text": op5_html_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_url_filter": op9_url_filter,
    "op10_avi_columns": op10_avi_columns,
    "op11_line_dedup": op11_line_dedup,
    "op12_bloom_search": op12_bloom_search,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op2_pfair_mix": mixing.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_bloom_search": lexical_search.SQL,
    "op13_collocations": collocations.SQL,
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(role) + length(text) + 23 + len(regexp_extract_all(role || chr(10) || text,
         '[<\[]\\*(?:\|role\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
}
