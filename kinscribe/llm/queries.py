"""The queries of the numbered operators over the tables of a folder, and the pipeline; oracle.py has DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .change_points import change_points
from .decontamination import find_contamination
from .license_scan import license_scan
from .line_dedup import line_classes
from .ngram_join import ngram_jaccard_join
from .oracle import oracle_sql  # noqa: F401
from .packing import pack_documents
from .quality_rules import repetition_quality
from .suffix_dedup import suffix_dedup
from .token_alignment import align_tokens
from .token_counts import count_tokens, flat_blocks
from .toxicity import toxicity_scores
from .url_filters import url_filter
from .warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark, sf_dir):
    d = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark, sf_dir):
    return repetition_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filters(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_token_counts(spark, sf_dir):
    return count_tokens(flat_blocks(table(spark, sf_dir, "documents"), byte_vocabulary())).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op5_decontamination(spark, sf_dir):
    d = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    names = F.array_sort(F.array_distinct("items"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), byte_vocabulary())


def op7_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op8_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark, sf_dir):
    return line_classes(table(spark, sf_dir, "documents"), shortest=1)


def op10_ngram_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op11_change_points(spark, sf_dir):
    lines = table(spark, sf_dir, "sale_lines").where("flag in ('kept', 'swapped')")
    return change_points(lines, "vendor_id", "shipped_at", "quantity").withColumnRenamed("key", "vendor_id")


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), byte_vocabulary(), public_tokenizers.path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_warc(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_url_filters, op4_token_counts, op5_decontamination, op6_packing, op7_license_scan, op8_toxicity, op9_line_dedup, op10_ngram_join, op11_change_points, op12_token_alignment, op13_warc)}
    return {**found, "pipeline": pipeline}
