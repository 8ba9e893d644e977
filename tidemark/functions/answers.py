"""A model as a plain function from prompts to answers, given by the caller, and its answers as columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.text import fenced_json


def answered(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str | None]], shape: str, fallback: str | None = None) -> DataFrame:
    """rows with the column answer, a struct of shape: what model says to each prompt, in batches on the executors.

    Markdown fences around JSON go. Where the model says nothing, raises, or says what isn't JSON of shape, the fallback
    (JSON) stands, or null. A null prompt isn't asked. The model is any function of a list of prompts that can be
    shipped to the executors: a client of a service, a local model, or a rule.
    """

    @F.pandas_udf(StringType())
    def said(prompts: pd.Series) -> pd.Series:
        asked = prompts.dropna()
        try:
            told = list(model(asked.tolist())) if len(asked) else []
        except Exception:  # noqa: BLE001  a model that fails is a model that says nothing
            told = [None] * len(asked)
        return pd.Series(told, index=asked.index, dtype=object).reindex(prompts.index)

    parsed = F.from_json(fenced_json(F.col("__said")), shape)
    whole = F.to_json(parsed) != "{}"
    rest = F.from_json(F.lit(fallback), shape) if fallback else F.lit(None).cast(f"struct<{shape}>" if "struct" not in shape else shape)
    return rows.withColumn("__said", said(F.col(prompt))).withColumn("answer", F.when(whole, parsed).otherwise(rest)).drop("__said")
