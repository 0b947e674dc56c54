"""Vectors from texts by a model that the caller brings; a hashing model for tests and offline use."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.shipping import ship

Model = Callable[[list[str]], list[list[float]]]


def hashing_model(dimension: int = 64) -> Model:
    """Unit vectors of signed, hashed word counts: equal texts have equal vectors everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).tolist()

    return embed


def embed(rows: DataFrame, key: str, text: str, model: Model, batch: int = 64, prefix: str = "") -> DataFrame:
    """(key, embedding) of every row; a batch that fails is tried text by text, and a text that fails has null.

    Equal texts meet the model once if rows are made distinct before.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = [prefix + (t or "") for t in f[text]], []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    out += model(part)
                except Exception:  # noqa: BLE001  the model is the caller's
                    for t in part:
                        try:
                            out += model([t])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pd.DataFrame({key: f[key], "embedding": out})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def check_dimension(vectors: DataFrame, column: str, expected: int) -> None:
    """Raise if a vector has another length; nulls and empty tables pass."""
    found = vectors.selectExpr(f"size({column}) as n").filter(f"n >= 0 and n <> {expected}").limit(1).collect()
    if found:
        raise ValueError(f"a vector has {found[0]['n']} dimensions, not {expected}")
