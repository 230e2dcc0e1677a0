"""Model calls: a prompt with a bounded preview of the data, answered by a provider that the caller plugs in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..operators.tabular import ROW

PREVIEW_ROWS, PREVIEW_CHARS = 20, 8000


class Provider(Protocol):
    def complete(self, prompt: str, model: str) -> str: ...


class ProviderError(RuntimeError):
    pass


def preview_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The first PREVIEW_ROWS rows, by the given columns or by row id."""
    order = order or [ROW] * (ROW in df.columns)
    return (df.orderBy(*order) if order else df).limit(PREVIEW_ROWS)


def preview(df: DataFrame | None) -> str:
    """The first rows as text, the number of all rows, cut at PREVIEW_CHARS characters; '' without data."""
    if df is None:
        return ""
    rows = preview_rows(df).drop(ROW).toPandas()
    return f"{rows.to_string()}\n({df.count()} rows total)"[:PREVIEW_CHARS]


def call(provider: str, prompt: str, model: str, data: DataFrame | None, known: dict[str, Provider]) -> str:
    if provider not in known:
        raise ProviderError(f"no provider {provider!r} is set up")
    text = preview(data)
    reply = known[provider].complete(f"{prompt}\n\n{text}" if text else prompt, model)
    if not reply:
        raise ProviderError(f"{provider} gave an empty reply")
    return reply
