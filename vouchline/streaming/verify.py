"""Verification on streams: every gate is row-local, so the batch columns serve append-mode streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vouchline.operators import gates


def verify_stream(requests: DataFrame) -> DataFrame:
    """A stream of stage outcomes with both verdicts; no state, no watermark."""
    return gates.pipeline_gate(gates.web_gate(requests))
