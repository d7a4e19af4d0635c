"""Streaming.

The reference has no streaming operators (no watermark, event-time window or state). The only
streaming-shaped need is applying the same audit rules to newly arriving rows, which
``dwell.streaming.audit`` does with ``foreachBatch`` over the batch rule aggregate.
"""
