"""Batch generation with a model function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def batch_generate(
    prompts: DataFrame,
    make_fn: Callable[[], Callable[[list[dict]], object]],
    on_error: str = "raise",
    strip: bool = False,
    with_columns: tuple[str, ...] = (),
) -> DataFrame:
    """One response per prompt: ``chat_id, turn, *with_columns, response, error``.

    ``make_fn`` runs once per task and returns the function to call with a prompt, a list of
    role/content dicts, and with each of ``with_columns`` by name (such as the model and temperature
    in force, W5), which are also passed through. Its answer is a text or an object with a ``content`` text. An error ends
    the job, or with ``on_error='record'`` is kept in ``error`` beside a null response. A task that
    is run again calls the function again.
    """
    if on_error not in ("raise", "record"):
        raise ValueError(f"unknown on_error: {on_error}")

    def answer(fn, prompt, given: dict) -> tuple[str | None, str | None]:
        try:
            said = fn([dict(message) for message in prompt], **given)
            words = said if isinstance(said, str) else said.content
            return (words.strip() if strip else words), None
        except Exception as problem:
            if on_error == "raise":
                raise
            return None, f"{type(problem).__name__}: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for batch in batches:
            given = batch[list(with_columns)].to_dict("records") if with_columns else [{}] * len(batch)
            said = [answer(fn, prompt, own) for prompt, own in zip(batch["prompt"], given, strict=True)]
            yield batch[["chat_id", "turn", *with_columns]].assign(
                response=[response for response, _ in said], error=[error for _, error in said]
            )

    kinds = dict(prompts.dtypes) | {"turn": "bigint"}
    passed = ", ".join(f"`{c}` {kinds[c]}" for c in ("chat_id", "turn", *with_columns))
    rows = prompts.select("chat_id", F.col("turn").cast("bigint").alias("turn"), *with_columns, "prompt")
    return rows.mapInPandas(run, f"{passed}, response string, error string")
