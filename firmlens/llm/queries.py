"""Registered queries of the operators for training data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.lineage import shared_folder
from firmlens.llm import alignment, archive, conversations, decontaminate, line_templates, near_dup, packing, pii, quality, secret_scan, subwords, topk, toxicity, wavelet


def vocabulary() -> str:
    """The public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def both_vocabularies() -> tuple[str, str]:
    """The byte-level and the piece vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def op1_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary)
    size = (F.length("ids") / 4).cast("long")
    return pieces.select(
        "doc_id", "start", size.alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def _judged(scored: DataFrame, score: str, held_out, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= least).cast("int").alias("predicted"),
    )


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = subwords.fold(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels, fold != 1)
    return _judged(toxicity.score(docs.select("doc_id", "text"), model), "toxicity", fold == 1, toxicity.THRESHOLD)


def op3_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = subwords.fold(F.col("doc_id"), 5)
    model = quality.fit(docs, labels, fold != 0)
    return _judged(quality.score(docs, model), "score", fold == 0, 0.3)


def op6_near_dup(spark, sf_dir):
    return near_dup.components(table(spark, sf_dir, "documents"))


def op7_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_templates.report(docs, line_templates.find_recurring(docs))


def op8_wavelet(spark, sf_dir):
    path = folder(spark, "tokens")
    wavelet.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary)
    return wavelet.read_tokens(spark, path)


def op9_pii(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    joined = lambda kinds: F.concat_ws(
        ",", F.flatten(F.array(*(F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds)))
    )
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined(pii.KINDS), 256).alias("base_sha256"),
        joined([*pii.KINDS, *pii.ADDED]).alias("spans"),
    )


def op10_archive(spark, sf_dir):
    path = folder(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    records = archive.read_archive(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secrets(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["way"] == "")
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in secret_scan.KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.array_join(F.transform("secrets", lambda s: s["way"]), ",").alias("ways"),
    )


def op12_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), both_vocabularies)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_near_dup": op6_near_dup,
    "op7_line_templates": op7_line_templates,
    "op8_wavelet": op8_wavelet,
    "op9_pii": op9_pii,
    "op10_archive": op10_archive,
    "op11_secrets": op11_secrets,
    "op12_repair": op12_repair,
    "op13_alignment": op13_alignment,
}
