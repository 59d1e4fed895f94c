"""Model providers as column functions: whatever answers a prompt about an image."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def answered_by(provider: Callable[[str, str], str], attempts: int = 1):
    """A function of (image, prompt) columns giving a struct of answer and error. A view that fails, as
    often as allowed, has the error's name and doesn't stop the others."""

    @F.pandas_udf("answer string, error string")
    def ask(images: pd.Series, prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for image, prompt in zip(images, prompts, strict=True):
            error = None
            for _ in range(attempts):
                try:
                    rows.append((provider(image, prompt), None))
                    break
                except Exception as e:  # noqa: BLE001 - any failure of a provider is recorded
                    error = type(e).__name__
            else:
                rows.append((None, error))
        return pd.DataFrame(rows, columns=["answer", "error"])

    return ask
