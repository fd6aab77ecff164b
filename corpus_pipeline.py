"""From raw documents to packed sequences; each stage is written and read again.

Every stage takes the documents that the one before kept and returns the same columns, the
last one the packed pieces. Stages that filter keep all documents that they do not reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.lineage import settled
from firmlens.llm import decontaminate, line_templates, near_dup, packing, subwords, toxicity
from firmlens.llm.queries import folder, table, vocabulary

#: Stages on word shingles take five words.
SHINGLE_WORDS = 5
#: Documents of which this share of the tokens recurs are copies for near_dup to choose among.
COPY = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Learns from labelled rows outside the held-out third."""
    learn = subwords.fold(F.col("doc_id"), 3) != 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    scored = toxicity.score(docs.withColumn("_columns", F.struct(*docs.columns)).select("_columns", "text"), model)
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select("_columns.*")


def _without_lines(docs: DataFrame, copy: float | None) -> DataFrame:
    out = line_templates.drop_recurring(docs, line_templates.find_recurring(docs, copy=copy))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go, but for their first document. Documents
    of which half or more recurs stay whole, so that the next stage can tell copies."""
    return _without_lines(docs, COPY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Of those that stay, lines that
    recur go as well, whatever share of a document they are."""
    kept = settled(spark, lambda: near_dup.drop_near_duplicates(docs, SHINGLE_WORDS))
    return _without_lines(kept, None)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = docs.withColumn("_columns", F.struct(*docs.columns)).select("_columns", "text")
    found = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("_columns.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, as pieces of documents."""
    return packing.pack_documents(docs, vocabulary)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
