"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import oracles
from tarn.llm.decontamination import contaminated
from tarn.llm.exact_dedup import exact_duplicates
from tarn.llm.merkle import merkle_manifest
from tarn.llm.minhash_dedup import near_duplicates
from tarn.llm.parity_join import jaccard_join
from tarn.llm.piece_viterbi import decode_pieces, encode_pieces
from tarn.llm.quality import quality_scores
from tarn.llm.ranked_search import ranked_documents
from tarn.llm.shared import ship_package
from tarn.llm.substring_dedup import remove_repeated_windows
from tarn.llm.suffix_dedup import remove_repeated_strings
from tarn.llm.token_counts import token_count_table
from tarn.llm.toxicity import toxicity
from tarn.llm.url_cascade import filter_urls

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


# The label columns of the tables, in the order of the classifier chain.
CATEGORIES = ("quality", "toxic")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"), digest_all=True)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return token_count_table(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), categories=CATEGORIES)


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    decoded = decode_pieces(encode_pieces(table(spark, folder, "documents")))
    return decoded.select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip")
    )


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    kept = remove_repeated_windows(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    kept = remove_repeated_strings(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return merkle_manifest(table(spark, folder, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_url_filters": op7_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# The others have no short SQL; their tests compare them with brute force.
SQL = {
    "op1_exact_dedup": r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM texts
""",
    "op7_url_filters": r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
),
rules(rule, rule_host, rule_path, action) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parsed JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT parsed.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parsed LEFT JOIN fits USING (page_id)
""",
    "op5_minhash_near_dedup": oracles.OP5,
    "op8_substring_dedup": oracles.OP8,
    "op11_ranked_search": oracles.OP11,
    "op12_ngram_jaccard_join": oracles.OP12,
    "op13_merkle_manifest": oracles.OP13,
}
