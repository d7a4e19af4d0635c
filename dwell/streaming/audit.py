"""Apply the audit rules (Q02) to rows arriving on a stream, one micro-batch at a time.

No new semantics: every micro-batch is evaluated with ``operators.quality.evaluate`` (one
aggregate) and the (batch_id, area, check, failures, status) rows are appended to a table.
Checkpointing of the stream goes to the caller's checkpoint location (shared storage).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.operators.quality import Rule, evaluate


def audit_batches(stream: DataFrame, rules: Callable[[DataFrame], Sequence[Rule]], output_path: str,
                  checkpoint_location: str, trigger_once: bool = True):
    """Start a streaming query that writes rule results per micro-batch to parquet at ``output_path``.

    ``rules`` builds the rule list for a batch DataFrame (rules are column expressions)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = evaluate(batch, rules(batch)).select(F.lit(batch_id).alias("batch_id"), "area", "check", "failures",
                                                   "status")
        out.write.mode("append").parquet(output_path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
