"""A store of model answers: what has been asked once is not asked again, by any job.

The store is a folder of Parquet files that only grows. Every call leaves a row: the digest
of client version and prompt, the answer (null if the call failed or the answer was not
accepted) and the time. A run asks each distinct prompt that has no accepted answer and fewer
failures than allowed, appends what came, and asks what failed again until nothing is left to
ask. Rows are written by Spark's commit, so a job that dies keeps the rounds it finished; only
answers of tasks that did not end are paid for again. Two runs at once may both ask a prompt;
readers take the least accepted answer, so all rows agree whichever they read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.joins import fan_out_join
from firmlens.functions.lineage import cut
from firmlens.operators.inference import infer

STORE = "digest string, raw string, asked_at timestamp"
TRIES = 3


def prompt_digest(prompt: Column, version: str) -> Column:
    """Key of an answer. The version names the client, its model and its settings."""
    size = F.lit(f"{len(version)}:{version}:")  # no version and prompt read like others
    return F.sha2(F.concat(size, prompt), 256)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All calls so far; an empty store is made where there is none."""
    spark.createDataFrame([], STORE).write.mode("append").parquet(path)
    return spark.read.schema(STORE).parquet(path)


def known(spark: SparkSession, path: str) -> DataFrame:
    """``digest, raw, failures``: one row per prompt that was ever asked."""
    calls = open_store(spark, path)
    return calls.groupBy("digest").agg(
        F.min("raw").alias("raw"), F.count(F.when(F.col("raw").isNull(), 1)).alias("failures")
    )


def answer(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[list[str]], list[str | None]]],
    keys: list[str],
    path: str,
    version: str,
    accept: Callable[[Column], Column] | None = None,
    tries: int = TRIES,
) -> DataFrame:
    """Key columns and ``raw`` for every row of ``prompts``, from the store at ``path`` and, for
    what it does not hold, from the client.

    ``accept`` judges an answer, for example by ``declared.read``; what it does not accept
    counts as failed. A prompt is asked at most ``tries`` times over all runs; after that its
    answer is null. A null prompt is not asked. Equal prompts are asked once, however many
    rows share one.
    """
    spark = prompts.sparkSession
    rows = cut(prompts.select(*keys, "prompt", prompt_digest(F.col("prompt"), version).alias("digest")))
    distinct = cut(rows.where("prompt is not null").groupBy("digest").agg(F.min("prompt").alias("prompt")))
    while True:
        settled = known(spark, path).where(F.col("raw").isNotNull() | (F.col("failures") >= tries)).select("digest")
        pending = cut(distinct.join(settled, "digest", "left_anti"))
        if pending.isEmpty():
            break
        # As many tasks as the session shuffles by, whatever the size of the files.
        dealt = pending.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest")
        answers = infer(dealt, make_client, ["digest"])
        if accept is not None:
            # Once from the client, then judged: a call is never repeated for its judgement.
            answers = cut(answers)
            fits = F.coalesce(accept(F.col("raw")), F.lit(False))
            answers = answers.withColumn("raw", F.when(fits, F.col("raw")))
        answers.withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(path)
    found = known(spark, path).select("digest", "raw")
    # A prompt that a third of all rows share has one answer, copied per salt.
    return fan_out_join(rows.drop("prompt"), found, "digest", keys).select(*keys, "raw")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the store anew at ``target``: one row for each answer, and the failures that are
    still open. Readers move to the new folder when it is whole."""
    calls = open_store(spark, path)
    best = calls.groupBy("digest").agg(F.min("raw").alias("best"))
    kept = calls.where("raw is null").join(best.where("best is null").select("digest"), "digest", "left_semi")
    answers = (
        calls.join(best.where("best is not null"), "digest")
        .where("raw = best")
        .groupBy("digest", "raw")
        .agg(F.min("asked_at").alias("asked_at"))
    )
    answers.select("digest", "raw", "asked_at").unionByName(kept).write.parquet(target)
