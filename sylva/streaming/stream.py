"""Streams of documents: parsing is a map on rows, so the same code serves streams; states and windows over their nodes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import shred


def shred_stream(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """NODE rows of a stream of documents, without state."""
    return shred(docs, text, doc_id, **options)


def count_elements(docs: DataFrame, time: str = "ts", window: str = "1 minute", late: str = "5 minutes", text: str = "text", **options) -> DataFrame:
    """Elements by name and window of the documents' time; rows later than `late` are dropped by the watermark.

    The document's number carries its time through the parser: doc_id is the time in microseconds.
    """
    timed = docs.select(F.unix_micros(F.col(time).cast("timestamp")).alias("doc_id"), F.col(text).alias("text"))
    nodes = shred(timed, **options).where("kind = 'element'")
    events = nodes.select(F.timestamp_micros("doc_id").alias("ts"), "name").withWatermark("ts", late)
    return events.groupBy(F.window("ts", window), "name").agg(F.count(F.lit(1)).alias("n"))


def fold_by(rows: DataFrame, key: str, order: str, step: Callable[[Any, dict], tuple[Any, Any]], start: Any, schema: str) -> DataFrame:
    """A state threaded through each key's rows in order: step(state, row) gives the next state and what is emitted.

    schema: of key, order and emitted value. For keys whose rows fit one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for r in pdf.sort_values(order).to_dict("records"):
            state, got = step(state, r)
            out.append((r[key], r[order], got))
        return pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in schema.split(",")])

    return rows.groupBy(key).applyInPandas(run, schema)
