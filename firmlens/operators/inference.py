"""Structured inference with a model client that the user supplies."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _answers(client: Callable[[list[str]], list[str | None]], asked: list[str]) -> list[str | None] | None:
    """One answer per prompt, or None when the call failed."""
    try:
        answers = list(client(asked))
    except Exception:  # whatever a client raises is a failed call
        return None
    return answers if len(answers) == len(asked) else None


def infer(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[list[str]], list[str | None]]],
    keys: list[str],
) -> DataFrame:
    """Raw responses to a prompt table: the key columns and ``raw``.

    ``make_client`` runs once per partition and returns a function from a batch of
    prompts to as many JSON texts (None for a failed call). Where a batch fails, its
    prompts are sent one by one, and those that fail again get a null answer: a failed
    call is data, and costs no other prompt. The responses are validated afterwards by
    ``parse_scores`` or ``parse_extractions``.
    """
    schema = T.StructType([prompts.schema[k] for k in keys] + [T.StructField("raw", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            asked = batch["prompt"].tolist()
            answers = _answers(client, asked)
            if answers is None:
                answers = [(_answers(client, [prompt]) or [None])[0] for prompt in asked]
            yield batch[keys].assign(raw=pd.Series(answers, index=batch.index, dtype=object))

    return prompts.select(*keys, "prompt").mapInPandas(run, schema)
