"""Audit rules applied to a file stream, micro-batch by micro-batch."""

import os
import tempfile

from pyspark.sql import functions as F

from dwell.functions.nulls import fails_between
from dwell.operators.quality import Rule
from dwell.streaming.audit import audit_batches


def test_audit_batches_on_file_stream(spark):
    root = tempfile.mkdtemp(prefix="dwell-stream-")
    src = os.path.join(root, "in")
    spark.createDataFrame([(1,), (9,), (None,)], "floor int").write.parquet(src)
    stream = spark.readStream.schema("floor int").parquet(src)
    q = audit_batches(stream, lambda b: [Rule("Domain", "floor within 1-8", fails_between("floor", 1, 8))],
                      os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(root, "out")).agg(F.sum("failures")).first()[0]
    assert got == 2
