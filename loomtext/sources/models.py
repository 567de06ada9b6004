"""Calling a model from tasks. The engine itself brings no client; stored responses are the default."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from loomtext.errors import ContractViolation, ModelUnavailable


class Model(Protocol):
    def complete_structured(self, system: str, user: str, schema: str) -> dict:
        """One answer by the schema; raises ContractViolation or ModelUnavailable."""


def answered(misses: DataFrame, system: str, schema: str, client: Callable[[], Model]) -> DataFrame:
    """cache_key, payload and error for rows (cache_key, prompt); a broken contract fails its row, an absent provider the job.

    client makes a model in each task; one retry for a broken contract.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["cache_key"], batch["prompt"], strict=True):
                payload, error = None, None
                for _ in range(2):
                    try:
                        payload, error = json.dumps(model.complete_structured(system, prompt, schema)), None
                        break
                    except ContractViolation as e:
                        error = f"{e.code}: {e}"
                    except ModelUnavailable:
                        raise
                rows.append((key, payload, error))
            yield pd.DataFrame(rows, columns=["cache_key", "payload", "error"])

    return misses.select("cache_key", "prompt").mapInPandas(ask, "cache_key string, payload string, error string")
