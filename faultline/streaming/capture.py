"""Capture from a stream: each micro-batch of failing rows is one execution of its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from faultline.operators.capture import bounded_sample, observations
from faultline.plans.checks import Check


def captured_stream(rows: DataFrame, check: Check, sink: Callable[[str, DataFrame], None]) -> DataStreamWriter:
    """A writer that gives each epoch's observations to the sink under the epoch's invocation id.

    A repeated epoch has the same id, so a sink that inserts only what is absent counts it once.
    """
    grain = [g.strip().lower() for g in check.grain]

    def capture(batch: DataFrame, epoch: int) -> None:
        sink(f"epoch-{epoch:010d}", observations(bounded_sample(batch, grain, check.limit)))

    return rows.writeStream.foreachBatch(capture)
