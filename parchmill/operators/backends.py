"""Plug-in text models, run inside Arrow-batched Python workers.

The default text operators are native expressions. A model plugs in through a
factory that Spark calls once per task, so weights load once and not per row.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions import text as tx

log = logging.getLogger(__name__)

# A loaded model: a batch of texts in, one result per text out.
Model = Callable[[Sequence[str]], Sequence[str]]
ModelFactory = Callable[[], Model]

# A loaded tokenizer: texts and a number of tokens in, the texts cut to that many tokens out.
Cutter = Callable[[Sequence[str], int], Sequence[str]]
CutterFactory = Callable[[], Cutter]


def cut_to_tokens(text: Column, n: int, cutter: CutterFactory | None = None) -> Column:
    """``text`` cut to ``n`` tokens: of a tokenizer, which is loaded once per task, or without one of white space.

    A text the tokenizer fails on is cut at white space.
    """
    plain = tx.first_tokens(text, n)
    if cutter is None:
        return plain
    loaded: list[Cutter] = []

    def cut(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(cutter())
        out: list[str | None] = []
        for value in texts.to_pylist():
            try:
                out.append(None if value is None else loaded[0]([value], n)[0])
            except Exception:
                log.exception("a text could not be cut by the tokenizer")
                out.append(None)
        return pa.array(out, pa.string())

    return F.coalesce(F.arrow_udf(cut, "string")(text), plain)


def first_loadable(*factories: ModelFactory) -> ModelFactory:
    """The first of several factories that works: a local folder, then a model hub."""

    def factory() -> Model:
        for candidate in factories:
            try:
                return candidate()
            except Exception:
                log.exception("text model could not be loaded, trying the next place")
        raise RuntimeError("no text model could be loaded")

    return factory


def run_model(
    df: DataFrame, factory: ModelFactory, in_col: str, out_col: str, ok_col: str, on_error: str | None
) -> DataFrame:
    """Add ``out_col`` and ``ok_col`` by running a model over the texts of ``in_col``.

    A failing batch is retried text by text, so one bad text costs only its own
    row: that row gets ``on_error`` (its input when None) and ok = false. A model
    that cannot be loaded fails every row the same way.
    """

    def one_by_one(model: Model, texts: list[str]) -> list[str | None]:
        results: list[str | None] = []
        for text in texts:
            try:
                results.append(model([text])[0])
            except Exception:
                log.exception("text model failed on one text")
                results.append(None)
        return results

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = factory()
        except Exception:
            log.exception("text model could not be loaded")
            model = None
        for batch in batches:
            texts = batch[in_col].tolist()
            if model is None:
                results = [None] * len(texts)
            else:
                try:
                    results = list(model(texts))
                    if len(results) != len(texts):
                        raise ValueError("the model returned another number of results")
                except Exception:
                    results = one_by_one(model, texts)
            batch[ok_col] = [r is not None for r in results]
            batch[out_col] = [
                (t if on_error is None else on_error) if r is None else r for t, r in zip(texts, results)
            ]
            yield batch

    kept = [f for f in df.schema.fields if f.name not in (out_col, ok_col)]
    schema = T.StructType([*kept, T.StructField(ok_col, T.BooleanType()), T.StructField(out_col, T.StringType())])
    return df.select(*[f.name for f in kept]).mapInPandas(run, schema)


def run_model_on_lists(df: DataFrame, factory: ModelFactory, in_col: str, out_col: str, ok_col: str) -> DataFrame:
    """As ``run_model`` for an array<string> column: all pieces of a batch of rows go to
    the model together. If any piece fails, the row gets NULL and ok = false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = factory()
        except Exception:
            log.exception("text model could not be loaded")
            model = None

        def translate_row(pieces: list[str]) -> list[str] | None:
            try:
                return list(model(pieces))
            except Exception:
                log.exception("text model failed on one row")
                return None

        for batch in batches:
            rows = [list(pieces) for pieces in batch[in_col]]
            if model is None:
                results: list[list[str] | None] = [None] * len(rows)
            else:
                try:
                    flat = list(model([piece for row in rows for piece in row]))
                    if len(flat) != sum(map(len, rows)):
                        raise ValueError("the model returned another number of results")
                    results, start = [], 0
                    for row in rows:
                        results.append(flat[start : start + len(row)])
                        start += len(row)
                except Exception:
                    results = [translate_row(row) for row in rows]
            batch[ok_col] = [r is not None for r in results]
            batch[out_col] = results
            yield batch

    kept = [f for f in df.schema.fields if f.name not in (out_col, ok_col)]
    schema = T.StructType(
        [*kept, T.StructField(ok_col, T.BooleanType()), T.StructField(out_col, T.ArrayType(T.StringType()))]
    )
    return df.select(*[f.name for f in kept]).mapInPandas(run, schema)
