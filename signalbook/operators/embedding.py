"""Vectors of texts from a model that the caller supplies."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list[str]], Sequence[Sequence[float]]]

_HELD = "_signalbook_models"


def _model_of(name: str, make: Callable[[], Model]) -> Model:
    """The model of this Python worker, made at its first task and kept for later ones; another name replaces it."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__
    if held.get("name") != name:
        held.pop("model", None)
        held.update(model=make(), name=name)
    return held["model"]


def _vectors(model: Model, texts: list[str], width: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A batch that fails is halved until the texts at fault stand alone."""
    try:
        found = np.asarray(model(texts), np.float32)
        if found.shape != (len(texts), width):
            raise ValueError(f"the model gave {found.shape} for {len(texts)} texts of width {width}")
    except Exception as e:  # noqa: BLE001  (whatever the model raises is the row's result)
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        half = len(texts) // 2
        return _vectors(model, texts[:half], width) + _vectors(model, texts[half:], width)
    return [(v, None) if ok else (None, "not finite") for v, ok in zip(found.tolist(), np.isfinite(found).all(1).tolist())]


def embed(
    df: DataFrame, make_model: Callable[[], Model], name: str, width: int, key: str = "row_id", text: str = "text",
    batch_rows: int = 256, batch_chars: int = 1_000_000,
) -> DataFrame:
    """(key, embedding, error): the vector of every text.

    ``make_model`` builds the model inside a worker, once for all its tasks under the same ``name`` (name and version of the model);
    it is called with lists of at most ``batch_rows`` texts and about ``batch_chars`` characters (a longer text is a list of its own). Every row comes
    back: null texts with neither vector nor error, texts the model fails on, gives a vector of another width or one that is not finite for
    with the error; other texts of their list are not affected. Empty texts are texts. Repeated rows give a row each; other columns are not read.
    """
    if width < 1 or batch_rows < 1:
        raise ValueError("width and batch_rows are at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model_of(name, make_model)
        for batch in batches:
            keys, texts, size = [], [], 0

            def made() -> pd.DataFrame:
                some = [t for t in texts if t is not None]
                results = iter(_vectors(model, some, width) if some else [])
                rows = [(k, *((None, None) if t is None else next(results))) for k, t in zip(keys, texts)]
                return pd.DataFrame({key: pd.Series(keys, dtype=batch[key].dtype), "embedding": [r[1] for r in rows], "error": [r[2] for r in rows]})

            for k, t in zip(batch[key], batch["_text"]):
                t = t if isinstance(t, str) else None
                if keys and (len(keys) >= batch_rows or size + len(t or "") > batch_chars):
                    yield made()
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(t)
                size += len(t or "")
            if keys:
                yield made()

    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.FloatType(), False)), T.StructField("error", T.StringType())])
    return df.select(F.col(key), F.col(text).alias("_text")).mapInPandas(run, schema)


class LetterCounts:
    """A small model without weights: the share of a text's letters a-z (any case) in each of ``width`` classes, by code."""

    def __init__(self, width: int = 8):
        self._width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self._width))
        for row, text in enumerate(texts):
            codes = np.frombuffer(text.encode("ascii", "ignore").lower(), np.uint8)
            codes = codes[(codes >= 97) & (codes <= 122)]
            out[row] = np.bincount(codes % self._width, minlength=self._width) / max(1, len(codes))
        return out
